import hashlib
import re

import pyarrow as pa
import pytest
from conftest_llm import DOCS, ODD
from pyspark.sql import functions as F

from sievework.llm import passages
from sievework.llm.passages import PhraseAutomaton, drop_repeated, repeated_passages

WORD = r"[^\x20\x09-\x0D]+"


def brute(rows, width):
    """By windows of words in plain Python."""
    worded = [(i, re.findall(WORD, t or "")) for i, t in rows]
    first = {}
    for i, ws in worded:
        if i is None:
            continue
        for k in range(len(ws) - width + 1):
            win = tuple(ws[k : k + width])
            first[win] = min(first.get(win, i), i)
    out = []
    for i, ws in worded:
        gone = set()
        for k in range(len(ws) - width + 1 if i is not None else 0):
            if first[tuple(ws[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def four(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def text(seed, n):
    return [f"w{(seed * 7919 + i * i * 31 + i * seed) % 5003}" for i in range(n)]


def planted():
    """Copies, near copies, shared passages at either end, inside and side by side, repeats inside one text."""
    a, b, c = text(1, 300), text(2, 120), text(3, 90)
    rows = [(10, a), (11, a), (12, a[:100] + ["changed"] + a[101:]), (3, b + text(4, 40)), (13, text(5, 30) + b), (14, b)]
    rows += [(15, text(6, 20) + c + text(7, 20) + c), (16, c), (17, c + c), (18, b + c), (19, c[:49]), (20, c[:50]), (21, a[50:99] + b[:49])]
    rows += [(22, ["same"] * 400), (23, ["same"] * 60), (24, (["x", "y"] * 150)), (25, ["y", "x"] * 30), (22, ["same"] * 400), (22, a[100:180])]
    rows += [(30 + i, text(100 + i, 25) + b[10:80] + text(200 + i, 25)) for i in range(30)]
    rows += [(None, a), (None, b), (60, [])]
    return [(i, " \n".join(w)) for i, w in rows]


@pytest.mark.parametrize("width", [50, 6])
def test_against_brute_force(table, width):
    rows = planted() + ODD
    assert four(repeated_passages(table(DOCS, rows), width)) == brute(rows, width)


def test_small_groups_shards_and_runs(spark, table, monkeypatch):
    """The same rows when every group holds little and passages are cut short on the driver's side."""
    monkeypatch.setattr(passages, "GROUP_WORDS", 500)
    assert four(repeated_passages(table(DOCS, planted()), 50)) == brute(planted(), 50)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert four(repeated_passages(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()], 50)


def test_automaton_finds_every_occurrence_and_no_other():
    phrases = [b"a b a", b"b a b a", b"c", b"zz a"]
    words = [b"a", b"b", b"a", b"b", b"a", b"other", b"c", b"zz", b"a", None, b"b", b"a"]
    end, which = PhraseAutomaton(phrases).occurrences(pa.array(words, pa.large_binary()))
    want = set()
    for p, phrase in enumerate(x.split() for x in phrases):
        want |= {(i + len(phrase), p) for i in range(len(words)) if words[i : i + len(phrase)] == phrase}
    assert set(zip(end.tolist(), which.tolist(), strict=True)) == want
    many = [f"w{i}".encode() for i in range(70_000)]  # three letters for each word
    found = PhraseAutomaton([b" ".join(many[i : i + 2]) for i in range(0, 70_000, 2)]).occurrences(pa.array(many[10:16], pa.large_binary()))
    assert found[0].tolist() == [2, 4, 6]


def test_spans_and_dropping(spark, table):
    rows = [(i, t) for i, t in planted() if i is not None]
    docs = table(DOCS, rows).withColumn("_spans", F.lit(1)).withColumn("File", F.lit("f"))
    kept = drop_repeated(docs)
    assert kept.columns == docs.columns
    want = {(i, n): sha for i, n, gone, sha in brute(rows, 50) if gone}
    texts = {(r.doc_id, len(re.findall(WORD, r.text or ""))) for r in docs.collect()}
    shas = {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in kept.collect() if r.text is not None}
    assert {(i, sha) for (i, _), sha in want.items()} <= shas
    assert set(want) <= texts
    for r in repeated_passages(table(DOCS, rows)).collect():
        assert sum(s.end - s.begin for s in r.removed) == r.n_removed
        assert all(s.end < t.begin for s, t in zip(r.removed, r.removed[1:], strict=False))


def test_bad_bytes_and_empty_table(spark, table):
    bad = spark.range(3).select(F.col("id").alias("doc_id"), F.expr("cast(unhex(repeat('80ff2041c320', 40)) as string)").alias("text"))
    assert [(r.doc_id, r.n_removed) for r in repeated_passages(bad).orderBy("doc_id").collect()] == [(0, 0), (1, 80), (2, 80)]
    blank = table(DOCS, [(i, " " * 200) for i in range(5)] + [(9, " ".join(text(1, 60))), (10, " ".join(text(1, 61)))])
    assert sorted(r.n_removed for r in repeated_passages(blank).collect()) == [0, 0, 0, 0, 0, 0, 60]
    assert repeated_passages(table(DOCS, [])).count() == 0
    assert drop_repeated(table(DOCS, [])).count() == 0
