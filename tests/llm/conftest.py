import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def table(spark):
    """table("id long, text string", rows) with two more columns whose names clash with the operators' own."""

    def make(schema, rows):
        df = spark.createDataFrame(rows, schema)
        for name in ("size", "row"):
            if name not in df.columns:
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make
