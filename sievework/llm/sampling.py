"""Bounded samples that do not gather more the more tasks there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, column: str, rows: int, total: int) -> DataFrame:
    """At most ``rows`` distinct values of ``column``, those with the least hashes.

    ``total`` is about how many rows ``df`` has: values whose hash is too large to be among the
    least are left out before anything is gathered, so all tasks together send about eight times ``rows`` at most.
    """
    place = F.pmod(F.xxhash64(column), F.lit(1 << 30))
    share = min(1.0, 8 * rows / max(1, total))
    few = df.select(column).where(place < int(share * (1 << 30))).distinct()
    return few.orderBy(F.xxhash64(column), column).limit(rows)
