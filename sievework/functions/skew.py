"""Exact forms of joins and windows that stay parallel when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def salt_of(*cols: str, salts: int = SALTS) -> Column:
    """Deterministic salt, so that a retried task sends a row to the same place."""
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def salted_anti_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    condition: Column | None,
    spread: Sequence[str],
    salts: int = SALTS,
) -> DataFrame:
    """``left_anti`` on ``keys`` (+ residual ``condition``) with the left side split ``salts`` ways.

    The right side is repeated once per salt, so it should be the small one; nothing is
    broadcast unless Spark itself finds it below its broadcast threshold.
    """
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    l = left.withColumn("_salt", salt_of(*spread, salts=salts))
    on = l["_salt"] == r["_salt"]
    for k in keys:
        on = on & (l[k] == r[f"r_{k}"])
    if condition is not None:
        on = on & condition
    return l.join(r, on, "left_anti").drop("_salt")


def join_key(key: str, applies: Column, *spread: str) -> Column:
    """``key`` where a row takes part in a join, else a value no key equals.

    Rows that only pass through keep their own, evenly hashed places; a null would send them
    all to one task.
    """
    filler = F.concat(F.lit("\u0001"), F.xxhash64(*spread).cast("string"))
    return F.when(applies, F.col(key)).otherwise(filler)


def budget_prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    size: str,
    budget: Column | int,
    salts: int = SALTS,
) -> DataFrame:
    """Longest prefix (in ``order``, per ``keys``) whose running ``size`` stays within ``budget``.

    First every salt keeps the rows whose *preceding* sizes fit: that holds all prefix rows
    and the row that overflows, so the second pass over these few rows gives the same answer
    as one pass over the whole group.  Sizes must be positive.
    """
    budget = F.lit(budget) if isinstance(budget, int) else budget
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c not in keys]), F.lit(salts))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    before = F.coalesce(F.sum(size).over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    few = df.withColumn("_salt", salt).withColumn("_before", before).where(F.col("_before") <= budget)
    full = Window.partitionBy(*keys).orderBy(*order)
    running = F.sum(size).over(full.rowsBetween(Window.unboundedPreceding, 0))
    return few.withColumn("running", running).where(F.col("running") <= budget).drop("_salt", "_before")


def numbered(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str
) -> DataFrame:
    """``row_number`` per ``keys`` where a group is split by ``bucket``.

    ``bucket`` must not decrease along ``order``.  Rows are numbered inside their bucket and
    shifted by the sizes of the earlier buckets, so a hot key is spread over its buckets.
    """
    b = df.withColumn("_bucket", bucket)
    sizes = b.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offset = F.sum("_n").over(
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_bucket").alias("_b"),
        F.coalesce(offset, F.lit(0)).alias("_offset"),
    )
    within = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    ranked = b.withColumn("_rn", within)
    on = ranked["_bucket"] == offsets["_b"]
    for i, k in enumerate(keys):
        on = on & ranked[k].eqNullSafe(offsets[f"_k{i}"])
    return (
        ranked.join(offsets, on)
        .withColumn(name, (F.col("_rn") + F.col("_offset")).cast("int"))
        .drop("_bucket", "_b", "_rn", "_offset", *[f"_k{i}" for i in range(len(keys))])
    )


def preceding_rows(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    k: int,
    item: Column,
    name: str,
    block: int = 512,
) -> DataFrame:
    """Collect ``item`` of the ``k`` rows before each row; ``position`` is dense within ``keys``.

    A group is cut into blocks of ``block`` positions; the last ``k`` rows of a block are also
    sent to the next one, so each frame is complete inside its block.
    """
    pos = F.col(position) - 1
    own = F.floor(pos / block)
    copies = F.when(
        F.pmod(pos, F.lit(block)) >= block - k, F.array(own, own + 1)
    ).otherwise(F.array(own))
    w = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(-k, -1)
    return (
        df.withColumn("_item", item)
        .withColumn("_own", own)
        .withColumn("_block", F.explode(copies))
        .withColumn(name, F.collect_list("_item").over(w))
        .where(F.col("_block") == F.col("_own"))
        .drop("_block", "_own", "_item")
    )


def previous_value(
    df: DataFrame, keys: Sequence[str], value: str, name: str, width: int = 1024
) -> DataFrame:
    """Largest smaller ``value`` (an integer, distinct per group) in the same group.

    The lag runs inside buckets of ``width`` values; only the first row of a bucket looks at
    the maximum of the bucket before, so a long history is not one task's sort.
    """
    b = df.withColumn("_bucket", F.floor(F.col(value) / width))
    tops = b.groupBy(*keys, "_bucket").agg(F.max(value).alias("_top"))
    last = F.lag("_top").over(Window.partitionBy(*keys).orderBy("_bucket"))
    tops = tops.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_bucket").alias("_b"),
        last.alias("_last"),
    )
    inside = F.lag(value).over(Window.partitionBy(*keys, "_bucket").orderBy(value))
    b = b.withColumn("_in", inside)
    on = b["_bucket"] == tops["_b"]
    for i, k in enumerate(keys):
        on = on & b[k].eqNullSafe(tops[f"_k{i}"])
    return (
        b.join(tops, on)
        .withColumn(name, F.coalesce("_in", "_last"))
        .drop("_bucket", "_b", "_in", "_last", *[f"_k{i}" for i in range(len(keys))])
    )
