"""History, dismissals, intent, journeys, reports, sinks, whole scans."""

import json

import pytest
from pyspark.sql import functions as F

from sievework.operators import findings as fnd
from sievework.operators import history, intent, journeys, report
from sievework.functions.skew import previous_value
from sievework.operators.security import security_findings
from sievework.plans.scan import ScanOptions, deep_scan, persona_scan, scan
from sievework.sources import files as src
from sievework.sources import sinks
from sievework.sources.rules import check_rule

LOG = "project string, scan_id long, rule_id string, file string, line int, severity string"


def _log(spark, rows):
    df = spark.createDataFrame(rows, LOG)
    return df.withColumn("fingerprint", history.fingerprint(F.col("rule_id"), F.col("file"), F.col("line")))


def test_delta_counts(spark):
    scans = spark.createDataFrame(
        [("proj", 1, 99, 9, 9), ("proj", 2, 10, 3, 5), ("proj", 5, 7, 1, 4), ("single", 1, 4, 1, 1)],
        "project string, scan_id long, total_issues long, critical long, major long",
    )
    log = _log(spark, [("proj", 2, "a", "f", 1, "major"), ("proj", 2, "a", "f", 1, "major"), ("proj", 2, "b", None, None, "major"),
                       ("proj", 5, "b", None, None, "major"), ("proj", 5, "c", "f", 2, "minor"), ("proj", 1, "z", "f", 1, "major")])
    rows = history.quality_delta(scans, log).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.current_scan, r.previous_scan, r.delta_total, r.delta_critical, r.delta_major) == (5, 2, -3, -2, -1)
    assert (r.new_issues, r.fixed_issues) == (1, 2)


def test_delta_keeps_modes_apart(spark):
    rows = [("p", "full", 1, 5), ("p", "deep", 2, 50), ("p", "full", 3, 4)]
    scans = spark.createDataFrame(rows, "project string, scan_mode string, scan_id long, total_issues long").withColumns(
        {"critical": F.lit(0), "major": F.lit(0)}
    )
    log = _log(spark, [("p", 1, "a", "f", 1, "major")]).withColumn("scan_mode", F.lit("full"))
    out = history.quality_delta(scans, log).collect()
    assert [(r.scan_mode, r.delta_total, r.fixed_issues) for r in out] == [("full", -1, 1)]


def test_lifecycle(spark):
    log = _log(spark, [("p", 1, "a", "f", 1, "major"), ("p", 1, "b", "f", 1, "major"), ("p", 4, "a", "f", 1, "major"),
                       ("p", 9, "b", "f", 1, "major")])
    got = sorted((r.scan_id, r.fingerprint[0], r.status) for r in history.lifecycle(history.scan_rows(log), log).collect())
    assert got == [(1, "a", "new"), (1, "b", "new"), (4, "a", "recurring"), (4, "b", "fixed"), (9, "a", "fixed"), (9, "b", "new")]


EVENTS = "seq long, ts timestamp_ntz, rule_id string, file_pattern string, reason string"


def _events(spark, *rows):
    df = spark.createDataFrame([(i, r, p, f"why {i}") for i, (r, p) in rows], "seq long, rule_id string, file_pattern string, reason string")
    df = df.withColumn("project", F.lit("p"))
    return df.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))


def _kept(spark, state):
    f = spark.createDataFrame([("r", "src/App.py"), ("r", "lib/x_y.js"), ("r", None), ("s", "src/App.py")], "rule_id string, file string").withColumn("project", F.lit("p"))
    return sorted((r.rule_id, r.file or "") for r in history.unsuppressed(f.withColumn("line_no", F.lit(1)), state).collect())


def test_third_dismissal_suppresses(spark):
    every = [("r", ""), ("r", "lib/x_y.js"), ("r", "src/App.py"), ("s", "src/App.py")]
    for n in (1, 2):
        state = history.dismissal_state(_events(spark, *[(i, ("r", None)) for i in range(n)]))
        assert _kept(spark, state) == every
    state = history.dismissal_state(_events(spark, *[(i, ("r", None if i else "")) for i in range(3)]))
    assert _kept(spark, state) == [("s", "src/App.py")]
    row = state.first()
    assert (row["count"], row.reason, row.auto_suppress) == (3, "why 0", True)


@pytest.mark.parametrize("pattern, gone", [("SRC/a", "src/App.py"), ("x%y", "lib/x_y.js"), ("x_y", "lib/x_y.js"), ("\\", None)])
def test_pattern_dismissal(spark, pattern, gone):
    state = history.dismissal_state(_events(spark, *[(i, ("r", pattern)) for i in range(3)]))
    every = {("r", ""), ("r", "lib/x_y.js"), ("r", "src/App.py"), ("s", "src/App.py")}
    assert set(_kept(spark, state)) == every - {("r", gone)}


def test_clear(spark):
    events = _events(spark, *[(i, ("r", None)) for i in range(3)], (3, ("q", "a")), (9, ("q", "a")))
    clears = spark.createDataFrame([(5, "r", None), (5, "q", "a")], "seq long, rule_id string, file_pattern string").withColumn("project", F.lit("p"))
    got = {r.rule_id: r["count"] for r in history.dismissal_state(events, clears).collect()}
    assert got == {"q": 1}


def test_dismissals_stay_in_their_project(spark):
    state = history.dismissal_state(_events(spark, *[(i, ("r", None)) for i in range(3)]))
    found = spark.createDataFrame([("p", "r"), ("q", "r")], "project string, rule_id string").withColumns({"file": F.lit("f"), "line_no": F.lit(1)})
    assert [r.project for r in history.unsuppressed(found, state).collect()] == ["q"]
    others = _events(spark, *[(i, ("r", None)) for i in range(3)]).withColumn("project", F.lit("q"))
    clears = spark.createDataFrame([(9, "r", None, "p")], "seq long, rule_id string, file_pattern string, project string")
    state = history.dismissal_state(_events(spark, *[(i, ("r", None)) for i in range(3)]).unionByName(others), clears)
    assert [(r.project, r["count"]) for r in state.collect()] == [("q", 3)]


def test_fixes_without_line_or_new_code(spark, files):
    from sievework.operators import fixes

    table = files({"a.py": "x = eval(y)\nz"})
    schema = "project string, path string, line_no int, rule_id string, old_code string, new_code string, explanation string, confidence double"
    wanted = spark.createDataFrame([("p", "a.py", None, "r", "eval(y)", None, "", 0.9), ("p", "a.py", 3, "r", "z", "", "", 0.9)], schema)
    found = spark.createDataFrame([("p", "a.py", None, "r", "t", "major")], "project string, file string, line_no int, rule_id string, title string, severity string")
    usable = fixes.usable_fixes(wanted, found, table)
    assert [(r.line_no, r.rule_id) for r in usable.collect()] == [(None, "r")]
    done = fixes.apply_fixes(table, usable).first()
    assert (done.content, done.applied, done.tried) == ("x = \nz", 1, 1)


def test_fidelity(spark):
    rows = [("a", 1.0, 1.0), ("a", 0.0, 0.5), ("zero", 1.0, 0.0)]
    got = {r.intent_id: r.fidelity_score for r in intent.fidelity(spark.createDataFrame(rows, "intent_id string, score double, importance double")).collect()}
    assert got == {"a": 66.7, "zero": 0.0}


def test_journey_score(spark):
    steps = {
        "done": [("smooth", "click"), ("confused", "done")], "quit": [("smooth", "give_up")], "open": [("smooth", "click"), ("odd", "click")],
        "trunc": [("smooth", "x")] * 8 + [("confused", "x")] * 2,
    }
    rows = [(j, n, f, a, "") for j, s in steps.items() for n, (f, a) in enumerate(s)]
    df = spark.createDataFrame(rows, "journey_id string, step_num int, feeling string, action string, friction string")
    scored = journeys.journey_scores(df)
    assert {r.journey_id: r.experience_score for r in scored.collect()} == {
        "done": 75, "quit": int(30 * 0.7), "open": int(75 * 0.7), "trunc": int(90 * 0.7),
    }
    worst = journeys.worst_journey(scored).first()
    assert (worst.worst, worst.gate) == (21, 2)
    empty = journeys.worst_journey(scored.where("false")).first()
    assert (empty.worst, empty.gate) == (100, 0)


def _markdown(df):
    return "\n".join(r.text for r in df.orderBy(*report.ORDER).collect())


def test_markdown(files):
    found = security_findings(files({"b.py": "eval(x)", "a.py": "verify=False\neval(y)"}))
    text = _markdown(report.markdown(found))
    assert "| Critical | 2 |" in text and "| **Total** | **3** |" in text
    places = [line.split("`")[1] for line in text.split("\n") if line.startswith("- **[")]
    assert places == ["a.py:2", "b.py:1", "a.py:1"]
    assert text.index("### [!!!] CRITICAL (2)") < text.index("`a.py:2`") < text.index("### [!!] MAJOR (1)")


def test_json_records(files):
    rows = report.json_records(security_findings(files({"a.py": "eval(x)"}))).collect()
    issue = json.loads(next(r.body for r in rows if r.record == "issue"))
    assert issue["location"] == {"file": "a.py", "line": 1} and issue["rule_id"] == "dangerous-eval"
    head = json.loads(next(r.body for r in rows if r.record == "summary"))
    assert head["summary"]["total_issues"] == 1 and head["summary"]["engines_run"] == ["code"]


def test_order_and_gate(files, spark):
    found = fnd.in_order(security_findings(files({"a.b.py": "eval(x)", "a/b.py": "eval(x)", "c.py": "verify=False"})))
    assert [r.file for r in found.collect()] == ["a/b.py", "a.b.py", "c.py"]
    gates = spark.range(1).select(
        fnd.findings_gate(F.lit(1), F.lit(0)), fnd.findings_gate(F.lit(0), F.lit(2)), fnd.findings_gate(F.lit(0), F.lit(0)),
        fnd.score_gate(F.lit(39.9), (40, 70)), fnd.score_gate(F.lit(40), (40, 70)), fnd.score_gate(F.lit(70), (40, 70)),
    ).first()
    assert tuple(gates) == (2, 1, 0, 2, 1, 0)


@pytest.fixture(scope="module")
def none_installed(spark):
    return spark.createDataFrame([("none", "npm", "none")], "project string, ecosystem string, name string")


def test_scan_options(files, none_installed):
    table = files({"a.py": "import nope_x\neval(x)\nx = 1  # TODO: y\nfor a in b:\n    s += a", "b.min.js": "eval(x)"})
    rules = [check_rule({"id": "mine", "regex": "eval", "severity": "info"})]

    def ids(**kw):
        return sorted(r.rule_id for r in scan(table, none_installed, ScanOptions(**kw)).collect())

    assert ids(rules=rules) == ["dangerous-eval", "hallucinated-import", "mine", "mine"]
    assert ids(rules=[], strictness="high") == ["concat-in-loop", "dangerous-eval", "hallucinated-import"]
    assert ids(rules=[], strictness="odd") == ["dangerous-eval", "hallucinated-import"]
    assert ids(rules=[], security=False) == ["hallucinated-import"]
    assert ids(rules=[], ai_patterns=False, performance=False) == ["dangerous-eval"]
    assert ids(rules=[], ignore=["a.*"]) == []
    assert ids(rules=[], importable=["nope_x"]) == ["dangerous-eval"]


def test_scan_does_not_depend_on_partitions(files, none_installed):
    table = files([(f"p{i % 3}", f"d{i % 5}/f{i}.js", "/* a\n" * (i % 2) + "for (;;) {\nfetch(x)\neval(y)\n}\n*/ b\neval(z)") for i in range(40)])
    options = ScanOptions(strictness="high")
    one = sorted(scan(table.coalesce(1), none_installed, options).collect())
    many = sorted(scan(table.repartition(13), none_installed, options).collect())
    assert one == many and len(one) > 40


def test_incremental_scan_and_carry_forward(files, spark, none_installed):
    first = files({"a.py": "eval(x)", "b.py": "eval(x)"})
    state = src.next_state(first, spark.createDataFrame([], "project string, path string, md5 string"))
    second = files({"a.py": "eval(x)", "b.py": "x"})
    options = ScanOptions(rules=[])
    now = scan(second, none_installed, options, state=state)
    assert now.count() == 0
    log = history.issue_rows(scan(first, none_installed, options), F.lit(1))
    kept = history.carry_forward(
        history.issue_rows(now, F.lit(2)).drop("scan_id"), log.drop("scan_id"), src.unchanged(second, state)
    )
    assert [r.file for r in kept.collect()] == ["a.py"]
    changes = spark.createDataFrame([("p", "M\ta.py"), ("p", "D\tb.py"), ("p", "R100\told.py\tnew.py"), ("p", "")], "project string, line string")
    parsed = src.parse_name_status(changes)
    assert sorted(tuple(r) for r in parsed.collect()) == [("p", "a.py", "M", None), ("p", "b.py", "D", None), ("p", "new.py", "R", "old.py")]
    assert [r.file for r in scan(first, none_installed, options, changes=parsed).collect()] == ["a.py"]


def test_save_scan_twice_is_once(files, spark, tmp_path):
    root = str(tmp_path / "history")
    table = files([("p", "a.py", "eval(x)\nverify=False"), ("clean", "a.py", "x")])
    for _ in range(2):
        sinks.save_scan(security_findings(table), root, 1, projects=table)
    sinks.save_scan(security_findings(table).where("line_no = 1"), root, 2, projects=table)
    scans = sinks.read_scans(spark, root)
    assert sorted((r.project, r.scan_id, r.total_issues) for r in scans.collect()) == [("clean", 1, 0), ("clean", 2, 0), ("p", 1, 2), ("p", 2, 1)]
    log = sinks.read_issue_log(spark, root)
    assert log.count() == 3
    delta = {r.project: (r.delta_total, r.fixed_issues) for r in history.quality_delta(scans, log).collect()}
    assert delta == {"p": (-1, 1), "clean": (0, 0)}
    assert history.scan_history(scans, 1).first().scan_id == 2


def test_report_files(files, spark, tmp_path):
    found = security_findings(files({"a.py": "eval(x)"}))
    sinks.write_json_report(found, str(tmp_path / "json"), timestamp="2024-01-01T00:00:00Z", duration_ms=7)
    head = spark.read.json(str(tmp_path / "json" / "record=summary")).first()
    assert (head.timestamp, head.summary.scan_duration_ms) == ("2024-01-01T00:00:00Z", 7)
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    sinks.write_markdown_report(found, str(tmp_path / "md"))
    assert "## Issues" in [r.value for r in spark.read.text(str(tmp_path / "md")).collect()]


def test_read_tree(spark, tmp_path):
    root = tmp_path / "in put"
    (root / "p1" / "src").mkdir(parents=True)
    (root / "p1" / "src" / "a+b c.py").write_bytes(b"x = 1\r\ny = 2\r")
    (root / "p2").mkdir()
    (root / "p2" / "bad.py").write_bytes(b"\xff\xfe\x00")
    rows = src.read_tree(spark, str(root)).collect()
    assert [(r.project, r.path, r.content, r.language) for r in rows] == [("p1", "src/a+b c.py", "x = 1\ny = 2\n", "python")]
    sizes = {r.path: r.size_bytes for r in src.read_assets(spark, str(root)).collect()}
    assert sizes == {"src/a+b c.py": 13, "bad.py": 3}


def _files_read(df):
    """Rows of ``df`` and the files its scans opened."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan()
        rows = list(plan.executeCollect())
        leaves = plan.collectLeaves()
        return len(rows), sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rejects_are_told_and_never_read(spark, tmp_path):
    root = tmp_path / "in"
    files = {
        "p/src/a.py": b"x = 1", "p/src/b c+d.js": b"y\r\n", "p/node_modules/dep/i.js": b"z", "p/img/i.png": b"\x89PNG", "p/src/big.ts": b"1" * 3000,
        "p/src/bad.py": b"\xff\xfe", "p/src/wide.js": b"w" * 900, "p/Dockerfile": b"FROM x", "p/dist/x.js": b"d", "p/skip me/q.py": b"q", "q/README": b"hi",
        "p/src/x.min.js": b"m",
    }
    for path, data in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)
    where = (str(root), ["skip me/"], 2000)
    kept = src.read_tree(spark, *where)
    assert sorted(r.path for r in kept.collect()) == ["Dockerfile", "README", "src/a.py", "src/b c+d.js", "src/wide.js"]
    rows, opened = _files_read(kept)
    assert (rows, opened) == (5, 6)  # those and the one that turns out to be no text
    ledger = {r.path: (r.reason, r.size_bytes) for r in src.read_rejects(spark, *where).collect()}
    assert ledger == {
        "node_modules/dep/i.js": ("ignored", 1), "dist/x.js": ("ignored", 1), "skip me/q.py": ("ignored", 1), "src/x.min.js": ("ignored", 1),
        "img/i.png": ("unsupported", 4), "src/big.ts": ("oversize", 3000), "src/bad.py": ("undecodable", 2), "src/wide.js": ("minified", 900),
    }
    packages = src.npm_packages(kept, src.read_assets(spark, str(root)))
    assert [(r.project, r.name) for r in packages.collect()] == [("p", "dep")]


def test_bucketed_files_need_no_exchange(spark, files):
    table = files([("p", f"f{i}.js", "eval(x)") for i in range(20)])
    sinks.write_files(table, "bucketed_files", 4)
    stored = spark.table("bucketed_files")
    plan = security_findings(stored)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan
    assert security_findings(stored).count() == 20
    spark.sql("DROP TABLE bucketed_files")


def test_one_exchange_for_all_line_windows(files):
    plan = security_findings(files({"a.py": "eval(x)"}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1


def test_whole_jobs_run(files):
    table = files({"vercel.json": "{}", "api/a.js": "let cache = {}", "ui/b.tsx": "<p>JSON</p>"})
    assert {r.rule_id for r in deep_scan(table).collect()} == {"serverless-stateful-code"}
    assert "ui-jargon" in {r.rule_id for r in persona_scan(table).collect()}


def test_history_since(spark):
    rows = [("p", i, f"2024-01-{i:02d} 00:00:00") for i in (1, 10, 20, 30)]
    scans = spark.createDataFrame(rows, "project string, scan_id long, ts string").select("project", "scan_id", F.col("ts").cast("timestamp").alias("timestamp"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    assert [r.scan_id for r in history.scan_history(scans, since=history.ago("12d", now)).collect()] == [30, 20]
    assert [r.scan_id for r in history.scan_history(scans, since=history.ago("3w", now)).collect()] == [30, 20, 10]
    assert history.scan_history(scans, since=history.ago("30d")).count() == 0
    for bad in ("30", "d", "5m"):
        with pytest.raises(ValueError):
            history.ago(bad)


def test_json_report_has_all_parts(spark, files):
    found = security_findings(files({"a.py": "eval(x)"}))
    one = {n: spark.createDataFrame([("p", *v)], f"project string, {kinds}") for n, v, kinds in [
        ("scores", ("do it", 61.5), "raw_intent string, fidelity_score double"), ("architecture", ("two files",), "architecture_summary string"),
        ("context", (True, "flask"), "is_api boolean, frameworks string"),
    ]}
    results = spark.createDataFrame([("p", 0, "has a", "a", "PASS", None)], "project string, idx int, description string, expect string, status string, evidence string")
    body = {r.record: json.loads(r.body) for r in report.json_records(found, timestamp="t", duration_ms=3, results=results, **one).collect()}
    assert body["summary"]["summary"] == {
        "total_issues": 1, "critical": 1, "major": 0, "minor": 0, "info": 0, "fidelity_score": 61.5, "engines_run": ["code"], "scan_duration_ms": 3,
    }
    assert {k: body["summary"][k] for k in ("intent", "architecture_summary", "project_context")} == {
        "intent": "do it", "architecture_summary": "two files", "project_context": {"is_api": True, "frameworks": "flask"},
    }
    assert body["intent"] == {"idx": 0, "description": "has a", "expect": "a", "status": "pass"}
    assert json.loads(report.json_records(found).where("record = 'summary'").first().body).keys() == {"version", "project", "target", "summary"}


def test_lifecycle_kept_equals_the_whole_log_after_each_scan(spark, tmp_path):
    rows = [("p", s, f"r{k}", "a.py", k, "major") for s in range(1, 7) for k in range(6) if (s * k + s) % 3 or k == s]
    rows += [("q", s, "r", "b.py", s // 3, "minor") for s in (2, 5, 6)]
    log = _log(spark, rows).withColumn("scan_mode", F.lit("full"))
    kept = sinks.LifecycleTable(spark, str(tmp_path), buckets=2)
    for step, scan_id in enumerate(range(1, 7)):
        so_far = log.where(F.col("scan_id") <= scan_id)
        scans = history.scan_rows(so_far)
        prev = previous_value(scans.select("project", "scan_mode", "scan_id"), ["project", "scan_mode"], "scan_id", "prev_id")
        for _ in range(2 if step == 3 else 1):  # an update that is repeated
            kept.update(step, log.where(F.col("scan_id") == scan_id), prev.where(F.col("scan_id") == scan_id))
        want = history.lifecycle(scans, so_far)
        assert sorted(kept.statuses().select(want.columns).collect()) == sorted(want.collect())
        assert sorted(history.lifecycle_by_print(scans, so_far).select(want.columns).collect()) == sorted(want.collect())
    first = {(r.project, r.fingerprint): (r.first_scan, r.last_scan, r.seen) for r in kept.state.before(6).collect()}
    assert first["q", "r:b.py:1"] == (5, 5, 1) and first["q", "r:b.py:2"] == (6, 6, 1)


def test_a_log_stored_by_fingerprint_is_not_exchanged(spark):
    rows = [("p", s, f"r{k}", "a.py", k, "major") for s in (1, 2, 3) for k in range(20) if (s + k) % 4]
    log = _log(spark, rows)
    sinks.write_issue_table(log, "issues_by_print", 4)
    stored = spark.table("issues_by_print")
    scans = history.scan_rows(log)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for by_print, plain in ((history.quality_delta_by_print, history.quality_delta), (history.lifecycle_by_print, history.lifecycle)):
            found = by_print(scans, stored)
            plan = found._jdf.queryExecution().sparkPlan().toString()
            assert "issues_by_print" in plan
            executed = found._jdf.queryExecution().executedPlan().toString().split("\n")
            at = next(i for i, row in enumerate(executed) if "issues_by_print" in row)
            above = executed[:at][::-1]
            aggregates = [row for row in above if "Aggregate" in row][:2]
            below = above[: above.index(aggregates[-1])]
            assert not any("Exchange" in row for row in below)  # the log's groups are complete where they lie
            assert sorted(found.collect(), key=str) == sorted(plain(scans, log).select(found.columns).collect(), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE issues_by_print")
