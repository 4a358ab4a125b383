"""Contiguous shards of nearly equal bytes from a global prefix sum."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.sources.stage import staged

COLUMNS = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def _running(batches):
    """Adds each row's place and the bytes before it, both within its partition."""
    rows = size = 0
    for b in batches:
        own = b.column("size").to_numpy()
        before = size + np.cumsum(own) - own
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(rows + np.arange(len(own))), pa.array(before)], names=[*b.schema.names, "place", "before"]
        )
        rows, size = rows + len(own), size + int(own.sum())


def byte_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` in one of ``shards`` runs of the id order, sizes near equal.

    The size of a row is its text's UTF-8 bytes (null: none) plus 1.  Rows are dealt by range of
    (id, crc32, size, place of reading) and sorted; the running sums inside each range become
    global ones by adding the totals of the ranges before it.  A row belongs to the shard in whose
    equal part of all bytes its middle lies, so a shard differs from the target by less than one row.

    The place of reading only parts rows that are equal otherwise, so that one id held by very many
    rows spreads over ranges.  Null ids come first.  Repeated rows are rows like others; an empty
    table gives no rows; other columns are not read.  Nothing but one row per range and one per
    shard meets in one place.  ``grown_shard`` is null: this law moves rows when shards are added.
    """
    text = F.col(text_col)
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("read"),
    )
    order = ["doc_id", "text_crc32", "size", "read"]
    dealt = staged(narrow).repartitionByRange(*order).sortWithinPartitions(*order).drop("read")
    dealt = dealt.withColumn("part", F.spark_partition_id())
    kinds = "doc_id long, size long, text_crc32 long, part int, place long, before long"
    ranked = staged(dealt.mapInArrow(_running, kinds))

    totals = ranked.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    totals = totals.select(
        "part",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_ahead"),
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_ahead"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    middle = 2 * (F.col("before") + F.col("bytes_ahead")) + F.col("size")
    placed = ranked.join(F.broadcast(totals), "part").select(
        "doc_id", "size", "text_crc32", (F.col("place") + F.col("rows_ahead")).alias("rank"),
        F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * F.col("all_bytes")))).cast("int").alias("shard"),
    )
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # one row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
