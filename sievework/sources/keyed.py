"""Keyed state that is kept up to date batch by batch, as a compacted, bucketed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.schema import union_all


class KeyedTable:
    """The last value of every key, as of any of the latest micro-batches.

    A batch writes its changed keys as one delta; every ``every`` batches the deltas are merged into the whole state, so
    what is read is the live keys and a bounded number of deltas, however long the stream has run.  Both are
    partitioned by a hash of ``spread`` and only the buckets of the keys asked for are read.  Folders are
    reused in turn: nothing grows with the number of batches, and a batch that is repeated after
    a failure reads what it read the first time and replaces what it wrote.
    """

    def __init__(self, spark: SparkSession, root: str, keys: str, values: str, spread: Sequence[str], every: int = 16, buckets: int = 64):
        self.spark, self.root, self.every, self.buckets = spark, root, every, buckets
        self.keys = [c.split()[0] for c in keys.split(", ")]
        self.values = [c.split()[0] for c in values.split(", ")]
        self.schema = f"{keys}, {values}, gone boolean"
        self.spread = list(spread)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.spread), F.lit(self.buckets)).cast("int")

    def _whole(self, number: int) -> str:
        return f"{self.root}/whole/slot={number % 2}"

    def _delta(self, batch_id: int) -> str:
        return f"{self.root}/delta/slot={batch_id % (2 * self.every)}"

    def _read(self, kind: str, paths: list[str], buckets: list[int] | None) -> DataFrame:
        reader = self.spark.read.schema(f"{self.schema}, slot int, bucket int").option("basePath", f"{self.root}/{kind}")
        rows = reader.parquet(*paths)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def before(self, batch_id: int, touched: DataFrame | None = None) -> DataFrame:
        """Keys and values after all batches before ``batch_id``; of the buckets of ``touched`` only, if given."""
        buckets = None
        if touched is not None:  # as many numbers as there are buckets, at most
            found = touched.select(self._bucket().alias("b")).distinct().collect()
            buckets = None if len(found) == self.buckets else [r.b for r in found]
        whole = batch_id // self.every
        first = whole * self.every
        parts = [self._read("whole", [self._whole(whole)], buckets).withColumn("_batch", F.lit(-1))] if whole else []
        if first < batch_id:
            deltas = self._read("delta", [self._delta(b) for b in range(first, batch_id)], buckets)
            parts.append(deltas.withColumn("_batch", F.pmod(F.col("slot") - first, F.lit(2 * self.every))))
        if not parts:
            return self.spark.createDataFrame([], self.schema).drop("gone")
        rows = union_all(parts)
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*self.values, "gone"), "_batch").alias("v"))
        return last.where(~F.col("v.gone")).select(*self.keys, *[f"v.{c}" for c in self.values])

    def put(self, changes: DataFrame, batch_id: int) -> None:
        """Writes the changed keys of a batch: each once, with its values or ``gone``."""
        self._write(changes, self._delta(batch_id))
        if (batch_id + 1) % self.every == 0:
            old = self.before(batch_id).withColumn("gone", F.lit(False))
            new = self._read("delta", [self._delta(batch_id)], None).drop("slot", "bucket")
            kept = old.join(new.select(*self.keys), self.keys, "left_anti")
            self._write(kept.unionByName(new.where("NOT gone")), self._whole((batch_id + 1) // self.every))

    def _write(self, rows: DataFrame, path: str) -> None:
        columns = [*self.keys, *self.values, "gone"]
        rows.select(*columns, self._bucket().alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
