"""Deep checks, persona checks, reviews, fixes."""

import json

import pytest
from pyspark.sql import functions as F

from sievework.operators import external, fixes, persona
from sievework.operators.context import project_context
from sievework.operators.deep import code_checks, deep_findings
from sievework.plans.catalog import QUERIES

VERCEL = ("vercel.json", "{}")
API = ("package.json", '{"dependencies": {"express": "4"}}')
DEEP = {
    "state": ([VERCEL, ("api/a.js", "let rateStore = {}\nlet x = new Map()\nconst c = {}"), ("web/b.js", "let y = {}")],
              "serverless-stateful-code", [("api/a.js", 1), ("api/a.js", 2)]),
    "state without serverless": ([("api/a.js", "let y = {}")], "serverless-stateful-code", []),
    "timeout": ([VERCEL, ("a.py", "timeout = 60\nTimeout: 20000\ntimeout=31000 timeout=1\ntimeout: 99999999999999999999")],
                "timeout-exceeds-platform", [("a.py", 1), ("a.py", 3)]),
    "lambda timeout": ([("serverless.yml", ""), ("a.py", "timeout = 60")], "timeout-exceeds-platform", []),
    "recursion": ([VERCEL, ("api/a.js", 'fetch("/api/x")\nfetch("https://h.io/api/y")\nfetch("/other")'), ("b.js", 'fetch("/api/x")')],
                  "recursive-serverless-invocation", [("api/a.js", 1), ("api/a.js", 2)]),
    "listeners": ([("a.js", 'w.addEventListener("a", f)\nw.addEventListener("b", g)\nw.removeEventListener("b", h)\n'
                             'w.addEventListener("b", () => 1)\nw.addEventListener("c", async () => 1)'),
                   ("b.py", 'w.addEventListener("a", f)')],
                  "event-listener-leak", [("a.js", 1), ("a.js", 4), ("a.js", 5)]),
    "blob": ([("a.js", "createObjectURL(x)\ncreateObjectURL(y)"), ("b.js", "createObjectURL(x)\nrevokeObjectURL(u)")],
             "blob-url-leak", [("a.js", 1), ("a.js", 2)]),
    "effect": ([("a.js", 'useEffect(() => {\nw.addEventListener("x", f)\n}, [a])\nreturn 1'),
                ("b.js", 'useEffect(() => {\nw.addEventListener("x", f)\nreturn off\n}, [a])'),
                ("c.js", "useEffect(() => {\nx()\n}, [a])"),
                ("d.js", 'useEffect(() => {\nw.addEventListener("x", f)\nreturn off'),
                ("e.js", "useEffect(() => {\n" + "x\n" * 30 + 'w.addEventListener("x", f)')],
               "useeffect-missing-cleanup", [("a.js", 1)]),
    "race": ([("a.js", "b.onclick = async () => 1"), ("b.js", "isBusy = 1\n" + "x\n" * 8 + "b.onclick = async () => 1"),
              ("c.js", "isBusy = 1\n" + "x\n" * 9 + "b.onclick = async () => 1"),
              ("d.js", "b.onclick = async () => 1\n" + "x\n" * 19 + "loading")],
             "unguarded-async-handler", [("a.js", 1), ("c.js", 11)]),
    "no timeout": ([("a.py", "requests.get(u)\n\n\n\n\n\nTIMEOUT = 1\n\n\nhttpx.get(u)\n# fetch(u)\nx.fetch(u)\nx.fetchone(u); fetch(u)\nfetch(u)")],
                   "missing-api-timeout", [("a.py", 1), ("a.py", 10), ("a.py", 14)]),
    "upload": ([API, ("a.js", "x\nnew FileReader()"), ("b.js", "new FileReader()\nif (f.size > 1) x"), ("c.py", "FileReader")],
               "missing-filesize-validation", [("a.js", 2)]),
    "upload outside web": ([("a.js", "new FileReader()")], "missing-filesize-validation", []),
    "cors source": ([API, ("z.js", "cors: *"), ("b/a.js", "x\norigin = '*'\norigin = '*'"), ("b.js", "origin: *")],
                    "cors-wildcard-api", [("b/a.js", 2)]),
    "cors config": ([API, ("vercel.json", '{\n"Access-Control-Allow-Origin":\n"*"}'), ("a.js", "origin: *")],
                    "cors-wildcard-api", [("vercel.json", 3)]),
    "cors no api": ([("a.js", "origin: *")], "cors-wildcard-api", []),
}


def test_deep(files):
    table = files([(n, p, c) for n, (fs, _, _) in DEEP.items() for p, c in fs])
    got = {}
    for r in deep_findings(table, project_context(table)).collect():
        got.setdefault((r.project, r.rule_id), []).append((r.file, r.line_no))
    for name, (_, rule, want) in DEEP.items():
        assert sorted(got.get((name, rule), [])) == sorted(want), name


def test_deep_titles(files):
    table = files([("p", *VERCEL), ("p", "api/a.js", "let rateStore = {}\nvar t = [] // timeout: 45000")])
    titles = {r.rule_id: r.title for r in deep_findings(table, project_context(table)).where("line_no = 1 OR rule_id LIKE 'timeout%'").collect()}
    assert titles["serverless-stateful-code"] == "Stateful rate limiter in serverless function"
    assert titles["timeout-exceeds-platform"] == "Timeout (45s) exceeds vercel limit (30s)"


def test_effect_parity(files):
    table = files({"a.js": "useEffect(f)\nx()", "b.js": "useEffect(f)", "c.js": "useEffect(f)\n", "d.js": "useEffect(f)\n\n",
                   "e.js": "useEffect(f)\n}, [a]"})
    got = code_checks(table, project_context(table), parity=True, only=("useeffect-missing-cleanup",))
    assert sorted(r.file for r in got.collect()) == ["a.js", "d.js"]


def test_assets(files, spark):
    table = files([("cached", "vercel.json", '{"h": "Cache-Control"}'), ("open", "a.py", "")])
    rows = [(p, path, size) for p in ("cached", "open") for path, size in
            [("public/a.wasm", 1048576), ("public/b.wasm", 1048575), ("src/c.wasm", 9999999), ("static/x/d.PNG", 9999999), ("assets/e.JS", 2411725)]]
    assets = spark.createDataFrame(rows, "project string, path string, size_bytes long")
    got = deep_findings(table, project_context(table), assets).collect()
    assert sorted((r.project, r.file, r.title) for r in got) == [
        ("open", "assets/e.JS", "Large asset without cache headers (2.3MB)"),
        ("open", "public/a.wasm", "Large asset without cache headers (1.0MB)"),
    ]


def _signals(spark, **flags):
    row = {s: False for s in persona.SIGNALS} | flags
    return spark.createDataFrame([("p", *row.values())], "project string, " + ", ".join(f"{s} boolean" for s in row))


PEOPLE = [
    ({"has_file_upload": True, "has_roles": True}, ["Content Creator", "Administrator", "First-Time Visitor"]),
    ({"has_dashboard": True, "has_data_tables": True, "has_mobile_meta": True}, ["Business User", "First-Time Visitor", "Mobile User"]),
    ({"has_api_docs": True}, ["Developer", "First-Time Visitor"]),
    ({}, ["End User", "First-Time Visitor"]),
]


@pytest.mark.parametrize("flags, names", PEOPLE)
def test_personas(spark, flags, names):
    assert [r["name"] for r in persona.personas(_signals(spark, **flags)).orderBy("pos").collect()] == names


def test_persona_filter(spark):
    s = _signals(spark, has_roles=True)
    assert [r["name"] for r in persona.personas(s, "ADMIN").collect()] == ["Administrator"]
    assert persona.personas(s, "nobody").count() == 3


def test_persona_checks(files, spark):
    table = files({
        "ui/a.tsx": "<p>Bad JSON here</p>\n<b>exit code 4</b>\nxs.map((x) => x)\nuseQuery(q)",
        "ui/b.jsx": "xs.map((x) => x)\nif (xs.length === 0) 1\nfetch(u)\nLoading",
        "c.js": "throw new Error(`x ${y}`)\n// error.message\nconsole.error(e);\nerr.stack",
        "node_modules/d.tsx": "<p>API</p>", "index.html": "<html>", "s.css": "a{}\nb:hover{x:1}\nc:hover{}",
        "t.css": "b:hover{x:1}\nb:focus{}", "api/r.py": "x",
    })
    s = _signals(spark, has_roles=True, has_api_docs=True)
    people = persona.personas(s)
    assets = spark.createDataFrame([("p", "public/v.mp4", 6 * 1048576), ("p", "public/w.mp4", 5 * 1048576)], "project string, path string, size_bytes long")
    rows = persona.persona_findings(table, s, people, assets).collect()
    got = sorted((r.rule_id, r.file or "", r.line_no or 0, r.persona or "") for r in rows)
    visitor, admin, dev = "First-Time Visitor", "Administrator", "Developer"
    assert got == sorted([
        ("ui-jargon", "ui/a.tsx", 1, visitor), ("raw-error-code", "ui/a.tsx", 2, visitor),
        ("missing-loading-state", "ui/a.tsx", 0, ""), ("missing-empty-state", "ui/a.tsx", 0, ""),
        ("unfriendly-error", "c.js", 1, ""), ("unfriendly-error", "c.js", 3, ""), ("unfriendly-error", "c.js", 4, ""),
        ("hover-only-interaction", "s.css", 2, visitor), ("missing-viewport", "", 0, visitor),
        ("missing-api-docs", "", 0, dev), ("missing-export", "", 0, admin), ("large-asset-mobile", "public/v.mp4", 0, visitor),
    ])
    assert {r.title for r in rows if r.rule_id == "ui-jargon"} == {"Technical jargon in UI: 'JSON'"}


def test_signals(files):
    table = files({"a.tsx": "<FORM> Login", "dashboard/x.py": "t(", "dist/y.js": "stripe", "z.rs": "stripe", "s.css": "@media"})
    row = persona.project_signals(table).first().asDict()
    assert {k for k, v in row.items() if v is True} == {
        "has_forms", "has_auth", "has_admin", "has_dashboard", "has_i18n", "has_responsive_css"
    }


def test_reviews(spark):
    entry = {"severity": "MAJOR", "category": "Style", "title": "t", "line": 3, "confidence": 0.5, "extra": 1}
    texts = {
        "bare": json.dumps({"issues": [entry]}), "fenced": "ok\n```json\n" + json.dumps({"issues": [entry, {}]}) + "\n``` bye",
        "broken": '{"issues": [', "list": "[1]", "none": json.dumps({"issues": []}),
        "bad entries": json.dumps({"issues": [{"confidence": 3}, {"line": "x"}, {"line": 0}]}),
    }
    payloads = spark.createDataFrame([(k, "f.py", v) for k, v in texts.items()], "project string, path string, payload string")
    got = sorted((r.project, r.severity, r.category, r.title, r.file, r.line_no, r.confidence) for r in external.file_reviews(payloads).collect())
    default = ("minor", "logic", "LLM-detected issue", None, None, 0.7)
    full = ("major", "style", "t", "f.py", 3, 0.5)
    assert got == sorted([("bare", *full), ("fenced", *full), ("fenced", *default), ("bad entries", *default)], key=str)
    whole = spark.createDataFrame([("p", "```\n" + json.dumps([{"file": "a.py"}, {"line": 4}]) + "\n```"), ("q", "{}")], "project string, payload string")
    got = [(r.file, r.line_no, r.severity, r.rule_id) for r in external.project_reviews(whole).orderBy("seq").collect()]
    assert got == [("a.py", None, "major", "holistic-review"), (None, None, "major", "holistic-review")]


def test_step_evaluation(spark):
    rows = [(1, '```json\n{"feeling": "lost", "action": "done"}\n```'), (2, "sorry"), (3, "")]
    got = external.step_evaluations(spark.createDataFrame(rows, "n int, payload string")).orderBy("n").collect()
    assert [(r.feeling, r.action) for r in got] == [("lost", "done"), ("confused", "scroll"), ("confused", "scroll")]


def test_fixes(files, spark):
    table = files({"a.py": "x = 1  \ny = eval(a)\nz = eval(a)\n"})
    schema = "project string, path string, line_no int, rule_id string, old_code string, new_code string, explanation string, confidence double"
    plan = [
        ("p", "a.py", 2, "r", "eval(a)", "lit(a)", "", 0.9), ("p", "a.py", 1, "r", "x = 1\ny", "x = 2\ny", "", 0.9),
        ("p", "a.py", 3, "r", "missing", "q", "", 0.9), ("p", "a.py", 4, "r", "", "q", "", 0.9), ("p", "b.py", 1, "r", "x", "q", "", 0.9),
    ]
    proposed = spark.createDataFrame(plan, schema)
    found = proposed.select("project", F.col("path").alias("file"), "line_no", "rule_id", F.lit("t").alias("title"), F.lit("major").alias("severity"))
    usable = fixes.usable_fixes(proposed, found, table)
    assert sorted((r.line_no, r.confidence) for r in usable.collect()) == [(1, 0.9), (2, 0.9), (4, 0.9)]
    out = fixes.apply_fixes(table, usable).first()
    assert (out.content, out.applied, out.tried) == ("x = 1  \ny = lit(a)\nz = eval(a)\n", 1, 3)
    windows = {r.line_no: r.context for r in fixes.fix_windows(found.where("line_no = 2 AND file = 'a.py'"), table, 1).collect()}
    assert windows == {2: "1: x = 1  \n2: y = eval(a)\n3: z = eval(a)"}


def test_personas_are_not_broadcast(spark, tmp_path):
    spark.range(50).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    df = QUERIES["personas"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert df.select("project").distinct().count() == 50


@pytest.mark.parametrize("name", ["assertions", "file_reviews", "project_reviews"])
def test_payloads_are_parsed_once(spark, tmp_path, name):
    rows = spark.range(20).selectExpr("id AS event_id", "id % 7 AS user_id", "'click' AS event_type", "1.0D AS value")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    df = QUERIES[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    assert df.count() > 0
