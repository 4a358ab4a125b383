"""The named queries over the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import oracles as sql
from sievework.llm.decontaminate import leaks
from sievework.llm.hmm import hmm_scores
from sievework.llm.html import main_texts
from sievework.llm.idfiles import encoded_documents
from sievework.llm.lengths import encoded_lengths, histogram
from sievework.llm.middle import fill_in_middle, restored
from sievework.llm.neardup import Similarity, near_duplicates
from sievework.llm.packing import packed_documents
from sievework.llm.passages import repeated_passages
from sievework.llm.prefixes import prefix_trie, sequences, with_shared_starts
from sievework.llm.quality import BASE_RULES, POLICIES, Policy, ablations, fails, judge, ledger
from sievework.llm.sharding import byte_shards
from sievework.llm.ship import ship
from sievework.llm.urls import verdicts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_byte_prefix_shards")
def _(spark, sf):
    return byte_shards(table(spark, sf, "documents"), 8)


@query("op2_rule_ledger", sql.RULE_LEDGER)
def _(spark, sf):
    led = judge(ledger(table(spark, sf, "documents")), POLICIES["v2"])
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        fails(Policy("base", BASE_RULES)).alias("base_failed"), "kept", "failed", "only_rule",
    )


@query("op2_rule_ablations", sql.RULE_ABLATIONS)
def _(spark, sf):
    return ablations(ledger(table(spark, sf, "documents")), POLICIES["v2"])


@query("op9_length_histogram")
def _(spark, sf):
    return histogram(encoded_lengths(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


@query("op10_island_packing")
def _(spark, sf):
    return packed_documents(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_multi_index_neardup", sql.NEAR_DUPLICATES)
def _(spark, sf):
    found = near_duplicates(table(spark, sf, "documents"), Similarity(3, 85))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op8_latent_leaks")
def _(spark, sf):
    return leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op7_url_regression")
def _(spark, sf):
    return verdicts(table(spark, sf, "pages"))


@query("op6_hidden_markov_scores")
def _(spark, sf):
    return hmm_scores(table(spark, sf, "documents"))


@query("op5_boosted_main_text")
def _(spark, sf):
    return main_texts(table(spark, sf, "pages"))


@query("op4_mixed_range_coder")
def _(spark, sf):
    return encoded_documents(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op11_fill_in_middle", sql.FILL_IN_MIDDLE)
def _(spark, sf):
    made = fill_in_middle(table(spark, sf, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")).cast("binary"), 256).alias("restored_sha256"),
    )


@query("op12_repeated_phrases", sql.REPEATED_PHRASES)
def _(spark, sf):
    return repeated_passages(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op13_prefix_trie", sql.PREFIX_TRIE)
def _(spark, sf):
    return prefix_trie(with_shared_starts(sequences(table(spark, sf, "conversations"))))
