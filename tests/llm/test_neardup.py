import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from conftest_llm import DOCS, LONG, ODD
from pyspark.sql import functions as F

from sievework.llm import neardup as nd
from sievework.llm.components import connected


def words(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text, width):
    ws = words(text)
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1)))


def brute(rows, width, percent):
    """component of each row by comparing all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)], len(groups)


def texts(n=300, seed=5):
    """Copies, light and heavy edits of a few bases, chains of edits, and texts of their own."""
    rng = random.Random(seed)
    fresh = lambda k: [f"w{rng.randrange(5000)}" for _ in range(k)]
    bases = [fresh(rng.choice((5, 30, 120, 200))) for _ in range(8)]
    out = []
    for i in range(n):
        ws = list(rng.choice(bases)) if rng.random() < 0.8 else fresh(rng.randrange(1, 150))
        for _ in range(rng.choice((0, 0, 1, 2, 4, 10))):
            ws[rng.randrange(len(ws))] = f"e{rng.randrange(100_000)}"
        if rng.random() < 0.1:
            bases.append(ws)
        out.append((i * 3, " ".join(ws)))
    return out


def run(df, like):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in nd.near_duplicates(df, like).collect())


def test_groups_like_all_pairs(spark):
    for width, percent in ((3, 85), (5, 80)):
        rows = texts()
        want, groups = brute(rows, width, percent)
        df = spark.createDataFrame(rows, DOCS)
        assert run(df, nd.Similarity(width, percent)) == sorted((str(a), b, str(c)) for a, b, c in want)
        kept = nd.drop_near_duplicates(df, nd.Similarity(width, percent)).collect()
        assert len(kept) == groups
        assert {r.doc_id for r in kept} == {c for _, _, c in want}


def test_odd_rows(table, spark):
    rows = [*ODD, (20, LONG + " tail"), (None, "no id here"), (21, "ONE"), *[(30, "same text of five words")] * 50]
    want, groups = brute(rows, 3, 85)
    df = table(DOCS, rows)
    assert run(df, nd.Similarity(3, 85)) == sorted((str(a), b, str(c)) for a, b, c in want)
    kept = nd.drop_near_duplicates(df, nd.Similarity(3, 85))
    assert kept.columns == df.columns
    assert kept.count() == groups
    assert nd.near_duplicates(table(DOCS, [])).count() == 0
    assert nd.drop_near_duplicates(table(DOCS, [])).count() == 0


def test_columns_named_like_the_place_of_a_row(spark, tmp_path):
    """Columns _file, _line and _metadata pass through, from memory and from Parquet files."""
    schema = "doc_id long, text string, _file string, _LINE long, _metadata struct<file_path: string, row_index: long>"
    rows = [(i, f"the same five words {i // 2} stand in here", "f", 1, ("p", 1)) for i in range(10)]
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "docs"))
    plain = df.withColumn("_metadata", F.lit("x"))
    for docs in (df, plain, spark.read.parquet(str(tmp_path / "docs"))):
        kept = nd.drop_near_duplicates(docs, nd.Similarity(3, 85))
        assert kept.schema.names == docs.schema.names
        assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 6, 8]


def test_hot_group_of_edits_costs_few_pairs(spark):
    """Copies edited each in its own way stay apart without being paired with each other."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        ws = list(base)
        for k in rng.sample(range(150), 12):
            ws[k] = f"e{i}_{k}"
        rows.append((i, " ".join(ws)))
    like = nd.Similarity(3, 85)
    profile = nd.profiles(nd.with_place(spark.createDataFrame(rows, DOCS)), like, "doc_id", "text")
    everyone = profile.selectExpr("row", "sketch", "row AS component")
    assert nd._apart(everyone, profile, like).count() < 400
    assert run(spark.createDataFrame(rows, DOCS), like) == sorted((str(a), b, str(c)) for a, b, c in brute(rows, 3, 85)[0])


def test_index_keys_find_every_pair_within_the_distance():
    """Signatures that differ in at most 17 slots share a key."""
    rng = np.random.default_rng(2)
    real, nd._A = nd._A, nd._A
    sh = rng.integers(0, 2**48, (400, 60), dtype=np.uint64)
    sh[200:] = sh[:200]
    for i in range(200):
        sh[200 + i, : rng.integers(1, 9)] = rng.integers(0, 2**48)
    _, keys = nd._signatures(sh.reshape(-1), np.full(400, 60))
    x = sh.astype(np.uint32)
    slots = np.stack([(x * real[k] + nd._B[k]).min(1) for k in range(nd.CHUNKS * nd.CHUNK)], 1)
    near = (slots[:200] != slots[200:]).sum(1) <= 2 * nd.CHUNKS - 1
    assert near.sum() > 50
    assert all(set(keys[i]) & set(keys[200 + i]) for i in np.flatnonzero(near))


def test_keys_are_made_from_stored_slots(spark):
    """A row stores its 54 slots in 108 bytes; the 54 keys are made where they are dealt, equal rows once."""
    docs = spark.createDataFrame([(i, f"one two three four five six {i // 2}") for i in range(40)] + [(40, None)], "doc_id long, text string")
    profile = nd.profiles(nd.with_place(docs), nd.Similarity(3, 85), "doc_id", "text")
    assert "keys" not in profile.columns
    rows = profile.where("node IS NOT NULL").orderBy("doc_id").collect()
    assert {len(r.slots) for r in rows} == {2 * nd.CHUNKS * nd.CHUNK}
    sets = [nd._unpacked(bytes(r.shingles)) for r in rows]
    sketch, keys = nd._signatures(np.concatenate(sets), np.array([len(s) for s in sets]))
    assert sketch.view(np.int64).tolist() == [r.sketch for r in rows]
    narrow = profile.where("node IS NOT NULL").selectExpr("row", "sketch", "n_shingles AS n", "slots")
    got = narrow.mapInArrow(nd._keyed, "key long, row long, sketch long, n long").collect()
    want = [(int(k), r.row, r.sketch, r.n_shingles) for r, own in zip(rows, keys.view(np.int64), strict=True) for k in own]
    assert sorted(tuple(r) for r in got) == sorted(want)
    order = np.arange(nd.CHUNKS).repeat(nd.CHUNK) % 2
    assert all(((own & np.uint64(1)) == order).all() for own in keys)


def test_sets_of_pairs_meet_by_one_plan_at_any_size(spark):
    """No broadcast join while pairs are few, which would turn into shuffles of the sets at larger sizes."""
    docs = spark.createDataFrame([(i, f"a b c d e f g h {i}") for i in range(6)], "doc_id long, text string")
    profile = nd.profiles(nd.with_place(docs), nd.Similarity(3, 85), "doc_id", "text")
    row = [r.row for r in profile.orderBy("row").select("row").collect()]
    both = nd._with_sets(spark.createDataFrame([(row[0], row[1]), (row[0], row[2])], "a long, b long"), profile)
    sets = {r.row: r.shingles for r in profile.collect()}
    assert sorted((r.a, r.b, r.set_a, r.set_b) for r in both.collect()) == [(row[0], b, sets[row[0]], sets[b]) for b in row[1:3]]
    final = both._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("SortMergeJoin") == 2 and " Inner, BuildRight" not in final and " Inner, BuildLeft" not in final


def test_no_set_but_those_wanted_is_moved(spark):
    """Also when very many rows are wanted: a filter of fixed size let more and more others pass."""
    profile = spark.range(200_000).selectExpr("id % 7 * 8589934592 + id AS row", "CAST(CAST(id AS STRING) AS BINARY) AS shingles")
    wanted = profile.where("row % 2 = 0").select("row")
    got = nd._sets_of(wanted.union(wanted), profile)
    assert got.columns == ["row", "shingles"]
    assert got.where("row % 2 <> 0").count() == 0
    assert got.count() == 100_000 == got.distinct().count()
    last = spark.createDataFrame([(63, b"a"), (64, b"b"), (127, b"c"), (0, b"d")], "row long, shingles binary")
    assert sorted(r.row for r in nd._sets_of(last.where("row IN (63, 127)"), last).collect()) == [63, 127]


def test_sketches_are_not_dealt_with_keys():
    """A key is dealt with its row's number alone; batches of one key link to its first row."""
    batch = lambda keys, rows: pa.RecordBatch.from_pydict({"key": keys, "row": rows})
    batches = [batch([1, 2, 2], [10, 11, 12]), batch([2, 3], [13, 14]), batch([], []), batch([4, 4], [15, 16])]
    got = {}
    for b in nd._stars(iter(b.cast(pa.schema([("key", pa.int64()), ("row", pa.int64())])) for b in batches)):
        assert b.schema.names == ["kind", "key", "a", "b"]
        for r in b.to_pylist():
            got.setdefault(r["kind"], []).append((r["key"], r["a"], r["b"]))
    assert got[0] == [(2, 11, 12), (2, 11, 13), (4, 15, 16)]
    assert {(2, 11, 11), (2, 12, 12), (2, 13, 13), (4, 15, 15)} <= set(got[1])
    assert got[2] == [(1, 10, 10), (4, 15, 15)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r.vertex: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {v: v for e in edges for v in e}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {v: find(v) for v in parent}
    assert got == {v: c for v, c in want.items() if v != c}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
    assert Counter(got.values())[1000] == 100
