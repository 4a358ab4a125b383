import re
import zlib
from collections import Counter

import pytest
from conftest_llm import DOCS, ODD

from sievework.llm import quality
from sievework.llm.sharding import byte_shards


def test_shards_are_contiguous_balanced_and_gapless(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = byte_shards(docs, 8).collect()
    want = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in got) == sorted(want)
    for r in got:
        raw = (want[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    ranked = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in ranked] == sorted(want)
    for s in range(8):
        assert [r.slot for r in ranked if r.shard == s] == list(range(sum(r.shard == s for r in ranked)))
    sums = Counter()
    for r in got:
        sums[r.shard] += r["size"]
    target = sum(sums.values()) / 8
    assert max(abs(v - target) for v in sums.values()) <= max(r["size"] for r in got)


def test_shards_of_odd_rows(table):
    got = byte_shards(table(DOCS, ODD + [(11, "same")] * 200), 3).collect()
    assert len(got) == len(ODD) + 200
    assert {r.shard for r in got} <= {0, 1, 2}
    assert byte_shards(table(DOCS, []), 3).count() == 0


def measure(text):
    text = text or ""
    word = r"[^\x20\x09-\x0D]+"
    ws = re.findall(word, text)
    wins = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    often = Counter(wins)
    repeated = {i + k for i, w in enumerate(wins) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(word, x)]
    return {
        "n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated), "n_lines": len(lines),
        "n_letters": len(re.findall("[A-Za-z]", text)), "n_upper": len(re.findall("[A-Z]", text)),
        "n_high": sum(ord(c) > 127 for c in text), "n_exclaims": text.count("!"),
    }


def test_ledger_measures_like_brute_force(spark, sf, table):
    odd = quality.ledger(table(DOCS, ODD)).collect()
    assert len(odd) == len(ODD)
    want = sorted((str(i), tuple(measure(t).values())) for i, t in ODD)
    assert sorted((str(r.doc_id), tuple(r[m] for m in measure(""))) for r in odd) == want
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.ledger(docs).collect():
        assert {m: r[m] for m in quality.MEASURES} == measure(texts[r.doc_id])


def test_policies_ablations_and_filter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    policy = quality.POLICIES["v2"]
    rows = quality.judge(quality.ledger(docs), policy).collect()
    names = [n for n, _ in quality.RULES]
    for r in rows:
        failed = [n for i, n in enumerate(names) if r.failed >> i & 1]
        assert r.kept == (not failed)
        assert r.only_rule == (failed[0] if len(failed) == 1 else None)
    for a in quality.ablations(quality.ledger(docs), policy).collect():
        bit = 1 << names.index(a.rule)
        assert a.n_failed == sum(bool(r.failed & bit) for r in rows)
        assert a.n_only == sum(r.failed == bit for r in rows)
        assert a.n_kept_without == sum(not r.failed & ~bit for r in rows)
    kept = quality.keep_good(docs, policy)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)
    assert quality.keep_good(docs.selectExpr("*", "1 AS measures")).columns[-1] == "measures"


@pytest.mark.parametrize("version", ["v1", "v2"])
def test_quality_labels(spark, version):
    """Most rows labelled good stay, most labelled bad go."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.judge(quality.ledger(docs), quality.POLICIES[version]).join(labels, "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1 and r.n_words >= 10]
    bad = [r.kept for r in got if r.quality == 0]
    assert sum(good) >= 0.95 * len(good)
    assert sum(bad) <= 0.1 * len(bad)


def test_empty_table(table):
    assert quality.ledger(table(DOCS, [])).count() == 0
    assert quality.keep_good(table(DOCS, [])).count() == 0
