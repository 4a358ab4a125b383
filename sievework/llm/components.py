"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.sources.stage import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex now hangs on the least vertex of its neighbourhood."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex and its smaller neighbours now hang on the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``vertex`` and ``component`` (its least vertex) of every vertex that has an edge, but the least ones.

    Alternates the two star operations until the edges no longer change, which takes about the
    logarithm of the longest path.  Only aggregates with partial sums and joins that split hot keys are used; each
    round is written to the shared folder, so its lineage is one table.
    """
    now = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
        before, now = mark, staged(_small_star(_large_star(now)))
