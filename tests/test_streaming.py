"""Streams give what the batch jobs give."""

import random

from pyspark.sql import functions as F

from sievework.operators.context import project_context
from sievework.operators.history import dismissal_state
from sievework.plans.scan import ScanOptions, scan
from sievework.streaming import jobs
from sievework.sources.keyed import KeyedTable


def _parts(df, folder, n):
    """Write ``df`` as ``n`` files, one per value of ``part``."""
    for i in range(n):
        df.where(F.col("part") == i).coalesce(1).write.mode("append").parquet(folder)


def test_versions_are_scanned_when_they_change(spark, files, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    versions = [("a.py", "eval(a)"), ("a.py", "x"), ("a.py", "x"), ("a.py", "eval(a)"), ("b.py", "eval(b)")]
    tables = [files({p: c}).withColumn("seq", F.lit(i)) for i, (p, c) in enumerate(versions)]
    schema = tables[0].schema
    packages = spark.createDataFrame([("none", "npm", "none")], "project string, ecosystem string, name string")
    context = project_context(files({"x": ""}))
    for t in tables:
        t.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        jobs.scan_stream(stream, packages, context, root, f"{root}/cp", ScanOptions(rules=[])).awaitTermination()
    found = spark.read.parquet(f"{root}/findings")
    assert sorted((r.file, r.batch_id) for r in found.collect()) == [("a.py", 0), ("a.py", 3), ("b.py", 4)]
    state = {r.path: r.md5 for r in jobs.file_state(spark, root).before(5).collect()}
    assert state["a.py"] == files({"a.py": "eval(a)"}).first().md5


def test_one_batch_with_two_versions_takes_the_newest(spark, files, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    both = files({"a.py": "eval(a)"}).withColumn("seq", F.lit(1)).unionByName(files({"a.py": "x"}).withColumn("seq", F.lit(2)))
    both.coalesce(1).write.parquet(src)
    packages = spark.createDataFrame([("none", "npm", "none")], "project string, ecosystem string, name string")
    stream = spark.readStream.schema(both.schema).parquet(src)
    jobs.scan_stream(stream, packages, project_context(files({"x": ""})), root, f"{root}/cp").awaitTermination()
    assert spark.read.schema("file string, batch_id long").parquet(f"{root}/findings").count() == 0


def test_scan_stream_equals_batch(spark, files, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    table = files([("p", f"f{i}.js", f"eval({i})\nrequire('lib{i}')") for i in range(12)]).withColumn("seq", F.lit(0))
    table = table.withColumn("part", F.col("path").substr(2, 1).cast("int") % 3)
    _parts(table, src, 3)
    packages = spark.createDataFrame([("p", "npm", "lib3")], "project string, ecosystem string, name string")
    context = project_context(files({"x": ""}))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(src)
    jobs.scan_stream(stream, packages, context, root, f"{root}/cp").awaitTermination()
    got = spark.read.parquet(f"{root}/findings")
    assert got.select("batch_id").distinct().count() == 3
    batch = scan(table, packages, context=context)
    assert sorted(got.select(batch.columns).collect()) == sorted(batch.collect())


def test_local_modules_of_earlier_batches_are_known(spark, files, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    packages = spark.createDataFrame([("none", "npm", "none")], "project string, ecosystem string, name string")
    context = project_context(files({"x": ""}))
    for i, table in enumerate([{"util.py": "x = 1", "a.py": "import util"}, {"a.py": "import util\nimport nowhere_to_be_found"}]):
        table = files(table).withColumn("seq", F.lit(i))
        table.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(table.schema).parquet(src)
        jobs.scan_stream(stream, packages, context, root, f"{root}/cp").awaitTermination()
    found = spark.read.parquet(f"{root}/findings").collect()
    assert [(r.file, r.line_no, r.batch_id) for r in found] == [("a.py", 2, 1)]


def test_gates_do_not_depend_on_the_batch_size(spark, tmp_path):
    rows = [("p", 1, "major", i % 3) for i in range(5)] + [("p", 2, "critical", 2), ("q", 1, "minor", 0)]
    issues = spark.createDataFrame(rows, "project string, scan_id int, severity string, part int").withColumn("engine", F.lit("code"))
    src = str(tmp_path / "in")
    _parts(issues, src, 3)
    for n in (1, 3):
        out = str(tmp_path / f"out{n}")
        stream = spark.readStream.schema(issues.schema).option("maxFilesPerTrigger", n).parquet(src)
        jobs.run(jobs.gate_counts(stream), "", f"{out}/cp", "update", jobs.keep_latest(f"{out}/c")).awaitTermination()
        got = sorted((r.project, r.scan_id, r.total_issues, r.gate) for r in jobs.gate_alerts(spark, f"{out}/c").collect())
        assert got == [("p", 1, 5, 1), ("p", 2, 1, 2)]


def test_dismissal_counts(spark, tmp_path):
    rows = [(i, f"r{i % 4}", None if i % 3 else "p", "why", i % 3) for i in range(60)]
    events = spark.createDataFrame(rows, "seq long, rule_id string, file_pattern string, reason string, part int")
    events = events.withColumns({"ts": F.current_timestamp(), "project": F.concat(F.lit("p"), (F.col("seq") % 2).cast("string"))})
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    _parts(events, src, 3)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    jobs.run(jobs.dismissal_counts(stream), "", f"{out}/cp", "update", jobs.keep_latest(f"{out}/c")).awaitTermination()
    got = jobs.read_latest(spark, f"{out}/c", "project", "rule_id", "file_pattern")
    want = dismissal_state(events).select(got.columns)
    assert sorted(got.collect()) == sorted(want.collect())


def test_late_issues_are_dropped(spark, tmp_path):
    # a row is late against the watermark of the batch before its own
    rows = [("2024-01-01 00:10:00", 0), ("2024-01-01 05:00:00", 0), ("2024-01-01 09:00:00", 1),
            ("2024-01-01 00:20:00", 2), ("2024-01-01 09:30:00", 2)]
    issues = spark.createDataFrame(rows, "ts string, part int").select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), "part", F.lit("p").alias("project"), F.lit("critical").alias("severity")
    )
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    _parts(issues, src, 3)
    stream = spark.readStream.schema(issues.schema).option("maxFilesPerTrigger", 1).parquet(src)
    jobs.run(jobs.issue_rate(stream), out, f"{out}-cp").awaitTermination()
    got = sorted((str(r.window_start), r.total_issues, r.critical) for r in spark.read.parquet(out).collect())
    assert got == [("2024-01-01 00:00:00", 1, 1), ("2024-01-01 05:00:00", 1, 1)]


def test_keyed_table_equals_a_dictionary_and_stays_small(spark, tmp_path):
    r, want = random.Random(3), {}
    table = KeyedTable(spark, str(tmp_path), "k string", "v long", ["k"], every=3, buckets=4)
    for batch in range(10):
        keys = r.sample("abcdefghij", 4)
        changes = [(k, None, True) if r.random() < 0.3 else (k, 10 * batch + i, False) for i, k in enumerate(keys)]
        assert {x.k: x.v for x in table.before(batch).collect()} == want
        some = spark.createDataFrame([(k,) for k in keys[:2]], "k string")
        seen = {x.k: x.v for x in table.before(batch, some).collect()}
        assert all(want.get(k) == seen.get(k) for k in keys[:2]) and seen.items() <= want.items()
        changed = spark.createDataFrame(changes, "k string, v long, gone boolean")
        if batch % 2:  # a batch that failed half way is repeated
            table.put(spark.createDataFrame([("z", 1, False)], changed.schema), batch)
        table.put(changed, batch)
        for k, v, gone in changes:
            want.pop(k, None) if gone else want.__setitem__(k, v)
    assert {x.k: x.v for x in table.before(10).collect()} == want
    rows = sum(spark.read.parquet(str(p)).count() for p in tmp_path.glob("*/slot=*") if list(p.glob("bucket=*")))
    assert rows <= 2 * 10 + 6 * 4  # two whole states and six deltas, whatever the number of batches


def _tree(spark, root, packages, context, files, steps):
    """Feeds the steps one by one; returns the current findings after each."""
    seen = []
    for i, (now, gone) in enumerate(steps):
        rows = files({**now, **{p: None for p in gone}}).withColumn("seq", F.lit(i))
        rows = rows.withColumn("deleted", F.col("path").isin(list(gone)))
        rows.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        jobs.scan_stream(stream, packages, context, root, f"{root}/cp", ScanOptions(strictness="high")).awaitTermination()
        seen.append(sorted((r.file, r.line_no, r.rule_id) for r in jobs.current_findings(spark, root, i + 1).collect()))
    return seen


def test_changes_back_deletions_and_moved_modules_equal_the_batch_scan(spark, files, tmp_path):
    root = str(tmp_path)
    packages = spark.createDataFrame([("none", "npm", "none")], "project string, ecosystem string, name string")
    context = project_context(files({"x": ""}))
    use = "import util\nimport lib.deep\n"
    steps = [
        ({"a.py": "eval(a)", "util.py": "x = 1", "lib/deep.py": "y = 1", "use.py": use, "gone.js": "eval(g)"}, ()),
        ({"a.py": "x"}, ("gone.js",)),
        ({"a.py": "eval(a)", "sub/util.py": "x = 1", "use.py": use + "z = 2"}, ("util.py",)),
        ({"a.py": "eval(a)", "sub/use.py": use}, ("lib/deep.py",)),
        ({"use.py": use}, ()),
    ]
    seen = _tree(spark, root, packages, context, files, steps)
    tree = {}
    for i, (now, gone) in enumerate(steps):
        tree = {p: c for p, c in {**tree, **now}.items() if p not in gone}
        whole = scan(files(tree), packages, ScanOptions(strictness="high"), context=context)
        want = sorted((r.file, r.line_no, r.rule_id) for r in whole.collect())
        # an import is judged when its file is scanned: step 3 takes lib away from a file it does not send
        if i == 3:
            assert set(want) - set(seen[i]) == {("use.py", 2, "hallucinated-import")}
            want = seen[i]
        assert seen[i] == want
    assert ("a.py", 1, "dangerous-eval") in seen[0] and ("a.py", 1, "dangerous-eval") not in seen[1] and seen[4]
    assert {r.path for r in jobs.file_state(spark, root).before(5).collect()} == set(tree)
    modules = {(r.dir, r.name): r.files for r in jobs.module_state(spark, root).before(5).where("project <> ''").collect()}
    assert modules == {("", "a"): 1, ("", "use"): 1, ("", "sub"): 2, ("sub", "util"): 1, ("sub", "use"): 1}


def test_late_versions_are_ignored(spark, files, tmp_path):
    root = str(tmp_path)
    packages = spark.createDataFrame([("none", "npm", "none")], "project string, ecosystem string, name string")
    for seq, text in [(5, "x"), (3, "eval(old)"), (6, "eval(new)")]:
        rows = files({"a.py": text}).withColumn("seq", F.lit(seq))
        rows.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        jobs.scan_stream(stream, packages, project_context(files({"x": ""})), root, f"{root}/cp").awaitTermination()
    assert [r.evidence for r in jobs.current_findings(spark, root, 3).collect()] == ["eval(new)"]
