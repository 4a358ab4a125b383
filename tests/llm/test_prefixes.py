import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sievework.llm import prefixes
from sievework.llm.prefixes import Forest, prefix_trie, sequences, with_shared_starts

TURNS = "conv_id long, turn long, role string, text string"


def brute_sequences(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, prefixes_key(r, x), r or "", x or ""))
    return {c: [v[3:] for v in sorted(vs, key=lambda v: v[:3])] for c, vs in own.items()}


def prefixes_key(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def brute_rebuilt(seqs):
    out = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = seqs.get(c - c % 100, [])[:h] + own[h:]
    return out


def brute_trie(seqs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in sorted(seqs.items()):
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    rows = []
    for p, m in members.items():
        sha = hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
        rows.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], sha))
    return sorted(rows, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(seed=5):
    """Starts that branch at every depth, copies, starts of each other, long ones and turnless ones."""
    r = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(100, 130), 205, 207, 301, 999, 1234567890123, 70000, 140000, 140001]:
        n = r.choice([1, 1, 2, 3, 5, 8, 12])
        rows += [(c, t, r.choice(["user", "user", "bot"]), r.choice(["a", "bb", "ccc ü"])) for t in range(n)]
    rows += [(c, t, "user", "hot") for c in range(400, 460) for t in range(4)]  # copies
    rows += [(500 + c, t, "user", "hot") for c in range(30) for t in range(c)]  # starts of each other
    rows += [(600, t, "u", str(t % 7)) for t in range(150)] + [(601, t, "u", str(t % 7)) for t in range(149)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("per_range", [20_000, 7, 1])
def test_against_brute_force(table, monkeypatch, per_range):
    monkeypatch.setattr(prefixes, "RANGE_ROWS", per_range)
    rows = made()
    df = table(TURNS, rows)
    found = with_shared_starts(sequences(df))
    want = brute_rebuilt(brute_sequences(rows))
    assert any(not s for s in want.values())
    assert got(prefix_trie(found)) == brute_trie(want)
    if per_range == 7:
        assert got(prefix_trie(sequences(df))) == brute_trie(brute_sequences(rows))


def test_whole_table(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    want = brute_rebuilt(brute_sequences([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]))
    assert got(prefix_trie(with_shared_starts(sequences(turns)))) == brute_trie(want)


def test_odd_rows(table):
    rows = [(None, 0, "user", "lost"), (1, None, None, None), (1, None, None, None), (1, 0, "user", ""), (1, 0, "", "user"), (1, 0, "", "user")]
    rows += [(2, None, "", ""), (2, 3, "x", "long " * 20_000), (-5, 1, "x", "y"), (-105, 1, "x", "y"), (-100, 0, "x", "y"), (-100, -1, "x", "z")]
    df = table(TURNS, rows).withColumn("key", F.lit(1)).withColumn("seq", F.lit(None))
    assert got(prefix_trie(sequences(df))) == brute_trie(brute_sequences(rows))
    truncated = {c: s for c, s in brute_sequences(rows).items()}
    for r in with_shared_starts(sequences(df)).collect():  # the remainder has the sign of the id
        source = r.conv_id - (r.conv_id % 100 if r.conv_id >= 0 else -(-r.conv_id % 100))
        h = zlib.crc32(str(r.conv_id).encode()) % 6
        want = truncated.get(source, [])[:h] + truncated[r.conv_id][h:]
        assert [t.key for t in r.turns] == [prefixes_key(*t) for t in want]
    assert prefix_trie(sequences(table(TURNS, []))).count() == 0
    only = prefix_trie(with_shared_starts(sequences(table(TURNS, [(105, 0, "a", "b")]))))
    assert got(only) == brute_trie(brute_rebuilt({105: [("a", "b")]}))


def test_ids_of_many_blocks(table, monkeypatch):
    monkeypatch.setattr(prefixes, "BLOCK", 10)
    rows = [(c, 0, "u", "same") for c in range(-40, 300)]
    assert got(prefix_trie(sequences(table(TURNS, rows)))) == brute_trie(brute_sequences(rows))


def test_merges_make_branching_nodes():
    a, b, c = (bytes([x]) * 16 for x in (1, 2, 3))
    tree = Forest([a, a + b, a + b + a, a + b + c, b])
    nodes = {(tree.depth[t], tree.first[t]): tree.children[t] for t in range(len(tree.depth))}
    assert nodes == {(1, 0): 1, (2, 1): 2, (3, 2): 0, (3, 3): 0, (1, 4): 0, (0, 0): 2}
