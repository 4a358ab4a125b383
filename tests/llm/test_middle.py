import hashlib

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import DOCS, ODD
from pyspark.sql import functions as F

from sievework.llm import middle
from sievework.llm.middle import fill_in_middle, restored

SPECIAL = [
    (20, "has <P> in it"), (21, "<S>"), (22, "a<M"), (23, "<P"), (24, "P>x<"), (25, "\U0001f600é日a" * 40), (26, "a\r\nb\n\nc"),
    *[(100 + i, "<S M> " * (i % 7) + "xy<" * (i % 3)) for i in range(60)],
]


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def as_set(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("segment", [1_000_000, 64])
def test_against_brute_force(table, monkeypatch, segment):
    rows = ODD + SPECIAL
    got = fill_in_middle(table(DOCS, rows))
    if segment == 64:  # cut by segments, in this process: tasks keep the module's own size
        monkeypatch.setattr(middle, "SEGMENT", segment)
        texts = [t for _, t in rows if t]
        draws = [np.array([7 * i * i + 3 for i in range(len(texts))]), np.array([11 * i + 1 for i in range(len(texts))])]
        n, low, high, pieces = middle.split_units(pa.array([t.encode() for t in texts], pa.large_binary()), draws, "character")
        for i, t in enumerate(texts):
            a, b = sorted(int(d[i]) % (len(t) + 1) for d in draws)
            assert (n[i], low[i], high[i]) == (len(t), a, b)
            assert [p[i].as_py().decode() for p in pieces] == [t[:a], t[a:b], t[b:]]
        return
    assert as_set(map(tuple, got.collect())) == as_set(brute(*r) for r in rows)
    forms = {r.form for r in got.collect()}
    assert forms == {"plain", "psm", "spm"}


def test_whole_table_and_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = fill_in_middle(docs).withColumn("back", restored(F.col("form"), F.col("output"))).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert as_set(tuple(r)[:6] for r in got) == as_set(brute(i, t) for i, t in texts.items())
    assert {r.doc_id: r.back for r in got} == {i: t or "" for i, t in texts.items()}


def test_lines_as_units(table):
    rows = [(i, "one\ntwo\n\nthree\nfour" + "\n" * (i % 2)) for i in range(40)]
    got = fill_in_middle(table(DOCS, rows), unit="line")
    for r in got.withColumn("back", restored(F.col("form"), F.col("output"))).collect():
        assert r.n == 5
        assert r.back == rows[r.doc_id][1]
        if r.form == "psm":
            lines = r.back.splitlines(keepends=True)
            assert r.output.startswith("<P>" + "".join(lines[: r.prefix_chars]) + "<S>")
    with pytest.raises(ValueError):
        fill_in_middle(table(DOCS, rows), unit="page")


def test_bad_bytes_long_texts_and_empty_table(spark, table):
    bad = spark.range(200).select(F.col("id").alias("doc_id"), F.expr("cast(unhex('80ff41c3e97a80') as string)").alias("text"))
    got = fill_in_middle(bad).withColumn("back", restored(F.col("form"), F.col("output")))
    assert got.count() == 200
    assert got.where("cast(back as binary) <> unhex('80ff41c3e97a80')").count() == 0
    long = table(DOCS, [(1, "añ" * 1_700_000), (2, "z" * 2_500_000)])
    got = fill_in_middle(long).withColumn("back", restored(F.col("form"), F.col("output")))
    assert got.join(long, "doc_id").where("back = text AND n = length(text)").count() == 2
    assert fill_in_middle(table(DOCS, [])).count() == 0
