"""Exact histogram of encoded lengths and the answers its suffix sums give."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm import texts as tx
from sievework.llm import tokens as tk
from sievework.sources.stage import staged

#: Lengths per group of the histogram; running sums are taken inside a group, then over the groups.
GROUP = 1024


def encoded_lengths(docs: DataFrame, path: str, words_only: bool = False, text_col: str = "text") -> DataFrame:
    """``n_tokens`` of every row's whole text (null: empty, 0) in one pass."""

    def run(batches):
        enc = tk.encoder(path, words_only)
        for _, texts in tx.parts(batches, "text", tk.BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(enc.lengths(texts), pa.int64())], names=["n_tokens"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """One row per length that occurs, in ``length`` order a step of every answer as a function of the limit.

    n_docs has exactly the length, n_docs_up_to at most it, n_docs_over more; tokens_up_to is the sum
    over the former; truncated_total is what remains of all tokens when every text is cut at the length, and
    lost_total what is cut off.  Lengths are counted before the shuffle, so a length shared by most
    rows is one row per task.  Sums run inside groups of 1024 neighbouring lengths and are shifted by the
    groups before, so no task holds the whole histogram.  An empty table gives no rows; a null or
    empty text has length 0; repeated rows each count.
    """
    counts = staged(lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs")))
    counts = counts.withColumn("part", F.expr(f"length div {GROUP}"))
    own = Window.partitionBy("part").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    inside = counts.select(
        "part", "length", "n_docs", F.sum("n_docs").over(own).alias("docs"), F.sum(F.col("n_docs") * F.col("length")).over(own).alias("tokens"),
    )
    groups = counts.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per 1024 lengths
    shift = groups.select(
        "part", F.coalesce(F.sum("d").over(ahead), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("t0"),
        F.sum("d").over(Window.partitionBy()).alias("all_d"), F.sum("t").over(Window.partitionBy()).alias("all_t"),
    )
    joined = inside.join(shift, "part")
    up_to, tokens = F.col("docs") + F.col("d0"), F.col("tokens") + F.col("t0")
    over = F.col("all_d") - up_to
    kept = tokens + over * F.col("length")
    return joined.select(
        "length", "n_docs", up_to.alias("n_docs_up_to"), over.alias("n_docs_over"), tokens.alias("tokens_up_to"),
        kept.alias("truncated_total"), (F.col("all_t") - kept).alias("lost_total"),
    )


def at_limits(hist: DataFrame, limits: DataFrame, limit: str = "context_limit") -> DataFrame:
    """For each row of ``limits`` the docs that fit and the tokens that remain, for limits between lengths too.

    The last step at or below a limit answers it: the longer texts add the distance each.  Limits below
    the shortest text keep ``limit`` tokens of every one.
    """
    steps = hist.agg(F.sum("n_docs").alias("all_docs")).crossJoin(F.broadcast(limits))  # one row times the limits
    last = limits.join(hist, F.col("length") <= F.col(limit)).groupBy(limit).agg(F.max_by(F.struct("*"), "length").alias("s"))
    s = F.col("s")
    return steps.join(last, limit, "left").select(
        limit, F.coalesce(s["n_docs_up_to"], F.lit(0)).alias("n_docs_fit"),
        F.coalesce(s["truncated_total"] + s["n_docs_over"] * (F.col(limit) - s["length"]), F.col("all_docs") * F.col(limit)).alias("truncated_total"),
    )


def quantile(q: float) -> Column:
    """Aggregate over a histogram: the least length that at least the share ``q`` of all texts do not exceed."""
    share = F.col("n_docs_up_to") / (F.col("n_docs_up_to") + F.col("n_docs_over"))
    return F.min(F.when(share >= q, F.col("length")))
