"""Every named query against its SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    text, _, ok = compare(spark, con, name, SF, entry.queries(), entry.oracle_sql())
    assert ok, text


def test_entry(spark):
    assert entry.entry(spark).count() > 0
