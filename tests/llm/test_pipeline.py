import subprocess
import sys

import corpus_pipeline
import pytest
from conftest_llm import DOCS, ODD
from oracle_check import compare

from sievework.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for name_of in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {name_of} AS SELECT * FROM '/root/testdata/sf0.001/{name_of}.parquet'")
    text, _, ok = compare(spark, con, name, "/root/testdata/sf0.001", queries.QUERIES, queries.ORACLES)
    assert ok, text


def test_stages_on_the_table(spark, tmp_path):
    """Each stage keeps the columns of documents and drops what its operator rejects; the last places all that is left."""
    from sievework.llm.decontaminate import leaks
    from sievework.llm.neardup import Similarity, near_duplicates
    from sievework.llm.quality import POLICIES, judge, ledger

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id for r in docs.collect()}
        if name == "quality_rules":
            want = {r.doc_id for r in judge(ledger(docs), POLICIES["v2"]).collect() if r.kept}
        elif name == "near_duplicates":
            want = {r.component_id for r in near_duplicates(docs, Similarity(5, 80)).collect()}
        elif name == "decontamination":
            want = ids - {r.doc_id for r in leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
        else:
            want = ids
            used = out.groupBy("sequence_id").sum("length").collect()
            assert max(r[1] for r in used) <= 4096
        assert {r.doc_id for r in out.collect()} == want
        if name != "packing":
            assert out.columns == docs.columns
        docs = out


def test_stages_on_odd_rows(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long, size string"
    docs = spark.createDataFrame([(i, t, None, None, None, "x") for i, t in ODD], columns)
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, "/root/testdata/sf0.001")
            rows.collect()
            if name != "packing":
                assert rows.columns == docs.columns


def test_library_stands_without_the_subpackage(tmp_path):
    """Without the corpus folders and the pipeline the entry module still offers the other queries."""
    import os
    import shutil

    top = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copy(f"{top}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{top}/sievework", tmp_path / "sievework", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') or k == 'pipeline' for k in q))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert got.stdout.split()[-1] == "False", got.stderr
