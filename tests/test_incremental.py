"""Incremental scans keep a complete history."""

import pytest
from pyspark.sql import functions as F

from sievework.operators.context import project_context
from sievework.operators.history import dismissal_state, issue_rows, quality_delta
from sievework.plans.scan import ScanOptions, incremental_scan, scan
from sievework.sources import sinks
from sievework.sources.files import changed_since, file_table, marked_since

HIGH = ScanOptions(strictness="high")
TREES = [
    [("p", "a.py", "eval(a)\neval(b)"), ("p", "b.js", "eval(c)"), ("p", "gone.py", "eval(g)"), ("q", "x.py", "eval(x)")],
    [("p", "a.py", "eval(a)"), ("p", "b.js", "eval(c)"), ("q", "x.py", "eval(x)\n")],
    [("p", "a.py", "eval(a)\neval(b)"), ("p", "b.js", "eval(c)"), ("p", "new.py", "eval(n)"), ("r", "r.py", "eval(r)")],
]


@pytest.fixture
def packages(spark):
    return spark.createDataFrame([("none", "npm", "none")], "project string, ecosystem string, name string")


def prints(df):
    return sorted((r.project, r.fingerprint) for r in df.collect())


def whole(files, packages, tree, step):
    found = scan(files(tree), packages, HIGH, project_context(files({"x": ""})))
    return prints(issue_rows(found, F.lit(step)))


def test_every_scan_is_complete_and_nothing_looks_fixed(spark, files, packages, tmp_path):
    root = str(tmp_path)
    context = project_context(files({"x": ""}))
    for step, tree in enumerate(TREES):
        incremental_scan(files(tree), packages, root, step, HIGH, context=context)
        log = sinks.read_issue_log(spark, root).where(F.col("scan_id") == step)
        assert prints(log) == whole(files, packages, tree, step)
        state = sinks.last_state(spark, root, "full", step + 1)
        projects = {p for p, _, _ in tree}
        assert sorted((r.project, r.path) for r in state.collect() if r.project in projects) == sorted((p, f) for p, f, _ in tree)
    delta = {r.project: r for r in quality_delta(sinks.read_scans(spark, root), sinks.read_issue_log(spark, root)).collect()}
    assert (delta["p"].new_issues, delta["p"].fixed_issues, delta["p"].delta_total) == (2, 0, 2)
    assert (delta["q"].current_scan, delta["q"].previous_scan, delta["q"].new_issues, delta["q"].fixed_issues) == (1, 0, 0, 0)
    assert "r" not in delta
    # q was left out of the last scan: its next one starts from the scan before
    incremental_scan(files([("q", "x.py", "eval(x)\n"), ("q", "y.py", "")]), packages, root, 3, HIGH, context=context)
    last = sinks.read_issue_log(spark, root).where("scan_id = 3")
    assert [r.fingerprint for r in last.collect()] == ["dangerous-eval:x.py:1"]


def test_a_scan_that_dies_leaves_the_old_one(spark, files, packages, tmp_path, monkeypatch):
    root, context = str(tmp_path), project_context(files({"x": ""}))
    incremental_scan(files(TREES[0]), packages, root, 0, HIGH, context=context)
    before = prints(sinks.read_issue_log(spark, root))
    write = sinks._replace_scan

    def dies(df, table, scan_mode, scan_id):
        if table.endswith("/scans"):
            raise OSError("executor lost")
        write(df, table, scan_mode, scan_id)

    monkeypatch.setattr(sinks, "_replace_scan", dies)
    with pytest.raises(OSError):
        incremental_scan(files(TREES[1]), packages, root, 1, HIGH, context=context)
    monkeypatch.setattr(sinks, "_replace_scan", write)
    assert prints(sinks.read_issue_log(spark, root)) == before
    assert {(r.project, r.path) for r in sinks.last_state(spark, root, "full", 9).collect()} == {(p, f) for p, f, _ in TREES[0]}
    for tree in (TREES[1], TREES[2]):  # the second run of the scan may see other files
        incremental_scan(files(tree), packages, root, 1, HIGH, context=context)
    log = sinks.read_issue_log(spark, root).where("scan_id = 1 AND project <> 'q'")
    assert prints(log) == whole(files, packages, TREES[2], 1)
    clean = [("p", "a.py", "x = 1"), ("r", "r.py", "")]
    incremental_scan(files(clean), packages, root, 1, HIGH, context=context)
    assert sinks.read_issue_log(spark, root).where("scan_id = 1").count() == 0
    assert sorted(r.project for r in sinks.read_scans(spark, root).where("scan_id = 1").collect()) == ["p", "r"]


def test_dismissals_hold_for_issues_taken_over(spark, files, packages, tmp_path):
    root, context = str(tmp_path), project_context(files({"x": ""}))
    tree = [("p", "a.py", "eval(a)"), ("p", "b.py", "eval(b)")]
    incremental_scan(files(tree), packages, root, 0, HIGH, context=context)
    events = spark.createDataFrame([("p", i, "dangerous-eval", "b.py", "ok") for i in range(3)],
                                   "project string, seq long, rule_id string, file_pattern string, reason string")
    state = dismissal_state(events.withColumn("ts", F.current_timestamp()))
    incremental_scan(files(tree), packages, root, 1, HIGH, context=context, dismissed=state)
    assert prints(sinks.read_issue_log(spark, root).where("scan_id = 1")) == [("p", "dangerous-eval:a.py:1")]


def test_history_without_scans(spark, tmp_path):
    root = str(tmp_path / "none")
    assert sinks.read_scans(spark, root).count() == sinks.read_issue_log(spark, root).count() == 0
    assert sinks.last_state(spark, root, "full", 5).count() == sinks.last_issues(spark, root, "full", 5).count() == 0


def test_files_are_read_once_a_scan(spark, files, packages, tmp_path):
    root, context = str(tmp_path), project_context(files({"x": ""}))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    for step, tree in enumerate(TREES):
        source = files(tree).select("project", "path", "content")
        incremental_scan(file_table(source.mapInPandas(counted, source.schema)), packages, root, step, HIGH, context=context)
        assert prints(sinks.read_issue_log(spark, root).where(F.col("scan_id") == step)) == whole(files, packages, tree, step)
    assert read.value == sum(map(len, TREES))


def test_marked_files_are_the_changed_ones(spark):
    def table(rows):
        return file_table(spark.createDataFrame([(p, f, c) for p, f, c in rows], "project string, path string, content string"))

    old = [("p", "same", "a"), ("p", "other", "a"), ("p", "none", None), ("p", "both", "a"), ("p", "both", "b"), ("p", "one", "a"), ("p", "one", "a"),
           ("p", "some", "a"), ("p", "some", None), ("p", "null", None), (None, "x", "a"), ("p", None, "a"), ("q", "same", "b")]
    new = [("p", "same", "a"), ("p", "other", "b"), ("p", "none", "a"), ("p", "both", "a"), ("p", "one", "a"), ("p", "some", "a"), ("p", "null", None),
           ("p", "new", "a"), ("p", "empty", None), ("p", "twice", "a"), ("p", "twice", "b"), ("p", "one", "c"), (None, "x", "b"), ("p", None, "b"),
           (None, None, "c"), ("q", "same", "a"), ("q", "twice", "a"), ("q", "twice", None)]
    for state in (table(old), table(old).limit(0)):
        files = table(new)
        marked = marked_since(files, state)
        assert sorted(map(repr, marked.select("project", "path", "md5").collect())) == sorted(map(repr, files.select("project", "path", "md5").collect()))
        assert marked.where("NOT changed AND content IS NOT NULL").count() == 0
        key = ["project", "path", "content", "md5", "ext", "size_bytes"]
        got, want = (sorted(map(repr, df.where("content IS NOT NULL").select(*key).collect())) for df in (marked.where("changed"), changed_since(files, state)))
        assert got == want and want
