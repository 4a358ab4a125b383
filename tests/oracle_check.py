"""Run named queries in Spark and their SQL in DuckDB on the same tables and compare.

    python tests/oracle_check.py [sf_dir] [name …]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from datetime import datetime

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def compare(spark, con, name, sf_dir, queries, oracles):
    t = time.time()
    df = queries[name](spark, sf_dir)
    cols = sorted(df.columns)
    mine = sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=repr)
    spent = time.time() - t
    if name not in oracles:
        return f"rows-only {len(mine)}", spent, True
    rel = con.sql(oracles[name])
    theirs_cols = sorted(rel.columns)
    if theirs_cols != cols:
        return f"columns differ: {cols} / {theirs_cols}", spent, False
    order = [rel.columns.index(c) for c in cols]
    theirs = sorted((tuple(normal(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    if mine == theirs:
        return f"ok {len(mine)}", spent, True
    a, b = set(map(repr, mine)), set(map(repr, theirs))
    only = "\n  spark: " + "\n         ".join(sorted(a - b)[:3]) + "\n  sql:   " + "\n         ".join(sorted(b - a)[:3])
    return f"DIFFER {len(mine)} / {len(theirs)} rows; cols {cols}{only}", spent, False


def main() -> int:
    import duckdb

    import __spark_entry__ as entry
    from sievework.session import get_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = get_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or queries:
        try:
            text, spent, ok = compare(spark, con, name, sf_dir, queries, oracles)
        except Exception as e:  # noqa: BLE001
            text, spent, ok = f"ERROR {type(e).__name__}: {str(e)[:1500]}", 0.0, False
        bad += not ok
        print(f"{name:32s} {spent:6.2f}s {text}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
