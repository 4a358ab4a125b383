"""Python facts, imports, the project index and project context."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sievework.operators.context import adjust_severity, project_context
from sievework.operators.findings import dedupe
from sievework.operators.imports import STDLIB, import_findings, python_findings, script_imports
from sievework.operators.index import (
    architecture_summary, context_pack, directory_summary, file_index, import_edges, top_files,
)
from sievework.operators.pyfacts import py_facts, register
from sievework.operators.security import security_findings
from sievework.plans.scan import ScanOptions, code_findings, scan
from sievework.sources.files import config_files, ignored, npm_packages, readmes, source_files
from sievework.sources.rules import built_in

PERF = {
    "nested": ("\nfor user in users:\n    for perm in permissions:\n        pass\n", {("nested-loop-on2", 2, 3)}),
    "small": ("\nfor i in range(5):\n    for j in range(5):\n        pass\n", set()),
    "len": ("for i in range(len(x)):\n    for j in y:\n        pass\n", {("nested-loop-on2", 1, 2)}),
    "io": ("\nfor uid in ids:\n    r = requests.get(uid)\n", {("io-in-loop", 3, None)}),
    "io in iter": ("for x in open(f):\n    pass\n", {("io-in-loop", 1, None)}),
    "suffix": ("while x:\n    spread(y)\n", {("io-in-loop", 2, None)}),
    "outside": ("open(x)\n", set()),
    "concat": ("while x:\n    s += 'a'\n    o.s += 'a'\n    n -= 1\n", {("concat-in-loop", 2, None)}),
    "async concat": ("async def f():\n    async for x in y:\n        s += x\n", set()),
    "triple": (
        "for a in x:\n    for b in y:\n        for c in z:\n            pass\n",
        {("nested-loop-on2", 1, 2), ("nested-loop-on2", 2, 3)},
    ),
    "first inner decides": ("for a in x:\n    for b in range(3):\n        pass\n    for c in z:\n        pass\n", set()),
    "call twice nested": ("for a in x:\n    for b in y:\n        read(b); write(b)\n", {("nested-loop-on2", 1, 2), ("io-in-loop", 3, None)}),
    "broken": ("for a in x:\n    for b in\n", set()),
    "null byte": ("for a in x:\n    for b in y: pass\0", set()),
}


def test_python_rules(files):
    table = files([(name, "t.py", text) for name, (text, _) in PERF.items()])
    got = {}
    rows = dedupe(python_findings(py_facts(table), None, None)).collect()
    for r in rows:
        got.setdefault(r.project, set()).add((r.rule_id, r.line_no, r.end_line))
    for name, (_, want) in PERF.items():
        assert got.get(name, set()) == want, name
    assert {r.title for r in rows if r.project == "call twice nested" and r.rule_id == "io-in-loop"} == {
        "I/O operation in loop: read"
    }


def _imports(files, spark, table, packages=()):
    pk = spark.createDataFrame(list(packages) or [("none", "npm", "none")], "project string, ecosystem string, name string")
    rows = dedupe(import_findings(table, py_facts(table), pk)).collect()
    return sorted((r.file, r.line_no, r.title.removeprefix("Hallucinated import: ")) for r in rows)


def test_imports(files, spark):
    table = files(
        {
            "test.py": "import nonexistent_magic_package\nimport os\nimport json\nimport sys, cgi\nfrom . import x\nfrom .y import z",
            "pkg/a.py": "import helper.sub\nimport beside\nimport top_dir\nfrom Requests_Toolbelt import x\nimport far",
            "pkg/beside.py": "", "helper/__init__.py": "", "top_dir/deep/m.py": "", "other/far.py": "",
            "two.py": "import zz_b, zz_a",
            "test.js": 'import { magic } from "totally-fake-package-xyz";\nimport { foo } from "./utils";\n'
            'import fs from "fs";\nconst p = require("node:path"), q = require("@scope/lib/x"), r = require("@/alias")\n'
            'export * from "known/sub"',
        }
    )
    got = _imports(files, spark, table, [("p", "npm", "known"), ("p", "pypi", "requests_toolbelt"), ("q", "npm", "@scope/lib")])
    assert got == [
        ("pkg/a.py", 5, "far"), ("test.js", 1, "totally-fake-package-xyz"), ("test.js", 4, "@scope/lib/x"),
        ("test.py", 1, "nonexistent_magic_package"), ("two.py", 1, "zz_b"),
    ]
    assert {"os", "typing_extensions", "__future__", "tomllib", "distutils"} <= set(STDLIB)
    assert script_imports(table).where("line_no = 4").count() == 3


def test_npm_packages(files):
    pkg = {"dependencies": {"a": "1"}, "peerDependencies": {"b": "1"}, "optionalDependencies": {"a": "2"}}
    table = files({
        "package.json": json.dumps(pkg), "node_modules/c/i.js": "", "node_modules/@s/d/i.js": "",
        "node_modules/.bin/x": "", "sub/node_modules/e/i.js": "",
    })
    assert {r.name for r in npm_packages(table).collect()} == {"a", "b", "c", "@s/d"}


CONTEXTS = {
    "vercel": ({"vercel.json": "{}"}, {"deployment": "vercel", "is_serverless": True}),
    "vercel dir": ({".vercel/project.json": "{}"}, {"deployment": "vercel"}),
    "order": ({"Dockerfile": "x", "netlify.toml": ""}, {"deployment": "netlify"}),
    "docker": ({"Dockerfile": "FROM node:20"}, {"deployment": "docker", "is_serverless": False}),
    "lambda": ({"serverless.yaml": ""}, {"deployment": "aws-lambda", "is_serverless": True}),
    "edge": ({"vercel.json": '{"functions": {"a": {"runtime": "Edge"}}}'}, {"has_edge_runtime": True}),
    "edge in key only": ({"vercel.json": '{"functions": {"edge": {"memory": 1}}}'}, {"has_edge_runtime": False}),
    "react": (
        {"package.json": '{"dependencies": {"react": "^18.0.0", "react-dom": "^18.0.0"}}'},
        {"frameworks": ["react"], "has_template_escaping": True, "is_web_app": True, "is_api": False},
    ),
    "django": (
        {"requirements.txt": "django==4.2\ndjango-rest-framework"},
        {"frameworks": ["django"], "has_orm": True, "has_csrf_protection": True, "is_api": True},
    ),
    "cli": ({"package.json": '{"bin": {"mycli": "./index.js"}}'}, {"is_cli": True, "is_web_app": False}),
    "orm": ({"package.json": '{"dependencies": {"prisma": "^5", "@prisma/client": "^5"}}'}, {"has_orm": True}),
    "bad json": ({"package.json": '{"dependencies": {"react":'}, {"frameworks": [], "config_files": ["package.json"]}),
    "page": ({"public/index.html": ""}, {"is_web_app": True}),
    "setup.cfg": ({"setup.cfg": "console_scripts"}, {"is_cli": True}),
    "helmet": ({"package.json": '{"devDependencies": {"helmet": "1", "cors": "1"}}'}, {"has_csrf_protection": True, "has_cors_configured": True}),
}


def test_context(files):
    table = files([(name, p, c) for name, (fs, _) in CONTEXTS.items() for p, c in fs.items()])
    got = {r.project: r.asDict() for r in project_context(table).collect()}
    for name, (_, want) in CONTEXTS.items():
        assert {k: got[name][k] for k in want} == want, name


def test_severity_by_context(files):
    code = {"a.js": "e.innerHTML = x", "b.tsx": "<i dangerouslySetInnerHTML={{}}/>", "c.py": 'execute(f"{x}")',
            "d.js": 'cors({ origin: "*" })', "e.js": 'localStorage.setItem("token", t)'}
    names = ["cli", "react", "orm", "django", "plain"]
    table = files([(n, p, c) for n in names for p, c in code.items()])
    manifests = files([(n, p, c) for n in names[:-1] for p, c in CONTEXTS[n][0].items()])
    out = adjust_severity(security_findings(table), project_context(manifests))
    got = {}
    for r in out.collect():
        got.setdefault(r.project, {})[r.rule_id] = r.severity
    base = {"xss-innerhtml": "critical", "xss-react-dangerous": "major", "sql-injection": "critical",
            "cors-wildcard": "info", "localstorage-sensitive": "major"}
    assert got["plain"] == base
    assert got["cli"] == {"sql-injection": "critical", "cors-wildcard": "info"}
    assert got["react"] == {**base, "xss-react-dangerous": "minor"}
    assert got["orm"] == {**base, "sql-injection": "minor"}
    assert got["django"] == {**base, "sql-injection": "minor", "cors-wildcard": "major"}


def test_file_filters(files):
    minified = "x" * 600
    table = files({
        "a.py": "x", "b.txt": "x", "node_modules/c.js": "x", "d.min.js": "x", "score.js": "x", "src/vendor-x.py": "x",
        "e.js": minified, "f.py": "\n" * 60 + "y" * 99999, "lib.egg-info/g.py": "x", "gen/h.py": "x", "docs/i.py": "x", "H.PY": "x",
    })
    assert {r.path for r in source_files(table, ["gen/*", "ocs/"]).collect()} == {"a.py", "src/vendor-x.py", "f.py", "H.PY"}
    assert table.where(ignored(F.col("path"))).count() == 4


def test_config_and_readme(files):
    table = files({"README": "last", "README.txt": "second", "sub/README.md": "no", "Dockerfile": "d" * 9000, "sub/package.json": "{}"})
    assert [(r.name, len(r.content)) for r in config_files(table).collect()] == [("Dockerfile", 5000)]
    assert [tuple(r) for r in readmes(table).collect()] == [("p", "README.txt", "second")]


@pytest.fixture(scope="module")
def project(spark):
    from sievework.sources.files import file_table

    rows = [
        ("src/app.py", "import os\nfrom lib.x import y\ncache = {}\nLIMIT = {}\ndef run(a):\n    inner = {}\nasync def go():\n    pass\nclass App:\n    pass\n"),
        ("src/ui/view.tsx", 'import a from "./part"\nimport b from "../base"\nconst c = require("react")\nlet seen = new Set()\n'
         "export function Show() {}\nconst load = async () => {}\nclass View {}\n"),
        ("src/ui/part/index.ts", "import z from './../../base'\n"), ("src/ui/part.jsx", "export 1\n"),
        ("src/base.js", "x\n" * 5), ("dist/out.js", "x"), ("readme.txt", "x"), ("vercel.json", '{"a": 1}'),
    ]
    return file_table(spark.createDataFrame([("p", *r) for r in rows], "project string, path string, content string"))


def test_index(project):
    ix = {r.path: r for r in file_index(project).collect()}
    assert set(ix) == {"src/app.py", "src/ui/view.tsx", "src/ui/part/index.ts", "src/ui/part.jsx", "src/base.js"}
    app, view = ix["src/app.py"], ix["src/ui/view.tsx"]
    assert (app.imports, app.functions, app.classes) == (["os", "lib.x"], ["run", "go"], ["App"])
    assert (app.global_state_lines, app.line_count, app.language) == ([3], 11, "python")
    assert view.imports == ["./part", "../base", "react"] and view.functions == ["Show", "load"]
    assert view.classes == ["View"] and view.global_state_lines == [4] and view.has_global_state


def test_edges_and_weights(project):
    ix = file_index(project)
    edges = import_edges(ix, project)
    assert sorted((r.src_path, r.dst_path) for r in edges.collect()) == [
        ("src/ui/part/index.ts", "src/base.js"), ("src/ui/view.tsx", "src/base.js"), ("src/ui/view.tsx", "src/ui/part.jsx"),
    ]
    top = [(r.path, r.score) for r in top_files(ix, edges, 2).orderBy("rank").collect()]
    assert top == [("src/base.js", 26), ("src/ui/part.jsx", 12)]


def test_summaries(project):
    ix = file_index(project)
    context = project_context(project)
    text = architecture_summary(ix, context).first().summary.split("\n")
    assert text[1:4] == ["Type: library", "Deployment: vercel", "Frameworks: none"]
    assert text[-1] == "Files with global state: src/app.py, src/ui/view.tsx"
    rows = directory_summary(project, 200).orderBy("running").collect()
    assert "".join(r.chunk for r in rows).startswith("\n--- src/app.py ---\nimport os")
    assert rows[-1].running == sum(len(r.chunk) for r in rows) <= 200
    pack = context_pack(project, ix, import_edges(ix, project), context)
    by = {}
    for r in pack.orderBy("section", "pos").collect():
        by.setdefault(r.section, []).append(r)
    assert [r.name for r in by[1]] == ["vercel.json"] and len(by[2]) == 5
    assert [r.name for r in by[3]][0] == "src/base.js" and len(by[3]) == 5
    assert "  src/app.py (11L) [GLOBAL_STATE, classes:App, fns:2]" in {r.text for r in by[2]}
    parts = sum(len(line) for line in by[0][0].text.split("\n")) + sum(len(r.text) for r in by[1] + by[2]) + 17
    fits = parts + len(by[3][0].text)
    cut = context_pack(project, ix, import_edges(ix, project), context, fits).where("section = 3")
    assert cut.count() == 1
    assert context_pack(project, ix, import_edges(ix, project), context, fits - 1).where("section = 3").count() == 0


def test_packages_beside_a_checkout_resolve(spark, files):
    table = files([
        ("p", "src/a.py", "import other\nimport lonely.part\nimport single\nimport inside\nimport nowhere_at_all\n"),
        ("other", "setup.py", "import p"), ("lonely", "README", "x"), ("single.py", "single.py", "x = 1"), ("q", "inside/x.py", "import p.src"),
    ])
    none = spark.createDataFrame([], "project string, ecosystem string, name string")
    found = import_findings(table, py_facts(table), none)
    assert sorted((r.project, r.title) for r in found.collect()) == [
        ("p", "Hallucinated import: inside"), ("p", "Hallucinated import: nowhere_at_all"),
    ]


def test_facts_as_a_table_function(spark, files):
    table = files({"a.py": "for x in xs:\n    for y in ys:\n        open(y)\n", "b.py": "import a, b\n", "c.py": "def (:", "d.py": "import"})
    register(spark)
    table.createOrReplaceTempView("checkout")
    got = spark.sql("SELECT f.* FROM checkout, LATERAL py_facts(project, path, content) f")
    assert got.columns == py_facts(table).columns
    want = {tuple(map(str, r)) for r in py_facts(table).collect()}
    assert want <= {tuple(map(str, r)) for r in got.collect()}  # c.py has no word the other form looks for
    assert spark.sql("SELECT f.kind FROM checkout, LATERAL py_facts(project, path, content) f WHERE f.path = 'c.py'").collect()[0].kind == "unparsed"
    found = python_findings(py_facts(table), None, None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert {(r.line_no, r.rule_id, r.end_line) for r in found.collect()} == {(1, "nested-loop-on2", 2), (3, "io-in-loop", None)}


def test_line_findings_are_not_shuffled_for_doubles(spark, files):
    table = files({"a.py": "eval(a)\nimport nothing_like_it, nothing_like_it\n", "b.js": "el.innerHTML = x"})
    none = spark.createDataFrame([], "project string, ecosystem string, name string")
    found = code_findings(table, none, ScanOptions(strictness="high"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("min_by") == 1 and "Union" in plan
    assert sorted(r.rule_id for r in found.collect()) == ["dangerous-eval", "hallucinated-import", "xss-innerhtml"]
    twice = [*built_in(), replace(built_in()[0], rule_id="dangerous-eval", regex="eval", exts=(), globs=(), hints=())]
    found = code_findings(table, none, ScanOptions(strictness="high", rules=twice))
    assert sorted(r.rule_id for r in found.collect()) == ["dangerous-eval", "hallucinated-import", "xss-innerhtml"]
    assert code_findings(table, none, ScanOptions(security=False, performance=False, ai_patterns=False, rules=[])) is None
    off = ScanOptions(security=False, performance=False, ai_patterns=False, rules=[])
    assert scan(table, none, off, context=project_context(table)).count() == 0
