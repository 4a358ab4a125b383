"""Known answers for the rules on single lines."""

import pytest

from sievework.operators.lines import line_findings
from sievework.operators.loops import loop_detectors
from sievework.operators.packs import pack_detectors
from sievework.operators.security import security_detectors
from sievework.sources.rules import SECURITY, check_rule, check_rules, java_regex, load_rule_dirs

# (name, file name, content, rule id, lines it is expected on)
CASES = [
    ("secret", "a.py", 'api_key = "sk-test-abc123def456ghi789jkl012"', "hardcoded-secret", [1]),
    ("secret upper", "a.js", 'const API_KEY = "sk-test-abc123def456ghi789jkl012"', "hardcoded-secret", [1]),
    ("secret from env", "a.py", 'api_key = os.getenv("API_KEY", "")', "hardcoded-secret", []),
    ("password", "a.go", 'password := "x"; pwd = "hunter22"', "hardcoded-password", [1]),
    ("password safe", "a.py", 'password = "abcd1234" if x else os.environ["P"]', "hardcoded-password", []),
    ("sql f-string", "a.py", "cursor.execute(f\"SELECT * FROM users WHERE id = '{user_id}'\")", "sql-injection", [1]),
    ("sql bound", "a.py", 'cursor.execute("SELECT * FROM users WHERE id = ?", (user_id,))', "sql-injection", []),
    ("sql concat", "a.py", 'cursor.execute("SELECT " + name)', "sql-injection", [1]),
    ("sql placeholders near", "a.py", 'params = (1, "?")\ncursor.execute(f"SELECT {c}")', "sql-injection", []),
    ("sql placeholders far", "a.py", 'params = (1, "?")\n' + "x = 1\n" * 30 + 'cursor.execute(f"SELECT {c}")', "sql-injection", [32]),
    ("sql table loop", "a.py", 'cursor.execute(f"DROP {table}")\nfor table in names: pass', "sql-injection", []),
    ("sql column toggle", "a.py", 'col = "a" if x else "b"\ncursor.execute(f"SELECT {col}")', "sql-injection", []),
    ("shell", "a.py", "subprocess.run(cmd, shell=True)", "command-injection", [1]),
    ("eval", "a.py", "result = eval(user_input)", "dangerous-eval", [1]),
    ("pickle", "a.py", "data = pickle.loads(untrusted)", "insecure-deserialization", [1]),
    ("yaml", "a.py", "cfg = yaml.load(f)", "unsafe-yaml", [1]),
    ("yaml loader", "a.py", "cfg = yaml.load(f, Loader=yaml.SafeLoader)", "unsafe-yaml", [1]),
    ("yaml loader after", "a.py", "cfg = yaml.load(f) # Loader", "unsafe-yaml", []),
    ("ssl", "a.py", "requests.get(u, verify=False)", "ssl-disabled", [1]),
    ("innerHTML variable", "a.js", "element.innerHTML = userInput", "xss-innerhtml", [1]),
    ("innerHTML template", "a.js", "element.innerHTML = `<div class='stat'>hello</div>`", "xss-innerhtml", []),
    ("innerHTML empty", "a.js", "container.innerHTML = '';", "xss-innerhtml", []),
    ("innerHTML in python", "a.py", "element.innerHTML = userInput", "xss-innerhtml", []),
    ("dangerous html", "a.tsx", "<i dangerouslySetInnerHTML={{ __html: h }} />", "xss-react-dangerous", [1]),
    ("js eval", "a.mjs", "new Function('return 1')()", "dangerous-eval-js", [1]),
    ("js sql", "a.ts", "const sql = `SELECT ${x}`", "sql-injection-js", [1]),
    ("document.write", "a.js", "document.write(x)", "document-write", [1]),
    ("storage", "a.js", 'LocalStorage.setItem("Token", t)', "localstorage-sensitive", [1]),
    ("cors", "a.js", 'cors: { origin: "*" }', "cors-wildcard", [1]),
    ("comment hash", "a.py", "# api_key = 'sk-test-abc123def456ghi789jkl012'", "hardcoded-secret", []),
    ("comment slashes", "a.js", "  // eval(x)", "dangerous-eval-js", []),
    ("block on a line", "a.js", "/* api_key = 'sk-test-abc123def456ghi789jkl012' */", "hardcoded-secret", []),
    ("block over lines", "a.js", "eval(a)\n/* open\neval(b)\nclose */ eval(c)\neval(d)", "dangerous-eval-js", [1, 5]),
    ("block never closed", "a.js", "/* open\neval(b)\n\neval(c)", "dangerous-eval-js", []),
    ("definition", "a.py", "X = re.compile('eval(')", "dangerous-eval", []),
    ("literal line", "a.py", "'eval(' in text", "dangerous-eval", []),
    ("docstring", "a.py", 'x = """eval("""', "dangerous-eval", []),
    ("fetch in loop", "a.js", "\nfor (const id of ids) {\n  const r = await fetch(`/u/${id}`);\n}\nfetch(x)", "fetch-in-loop", [3]),
    ("fetch in map line", "a.ts", "ids.map((i) => fetch(i))", "fetch-in-loop", [1]),
    ("dom in loop", "a.jsx", "while (x) {\n document.querySelector('a')\n}}}\nfor (y) {\n}\ndocument.querySelector('b')", "dom-in-loop", [2]),
    ("no loops in mjs", "a.mjs", "for (;;) { fetch(x) }", "fetch-in-loop", []),
    ("sync io", "a.js", 'const d = fs.readFileSync("c.json", "utf-8");', "sync-io", [1]),
    ("todo", "a.rs", "x(); // TODO: later", "todo-fixme-left", [1]),
    ("console", "a.ts", "console.log (1)\n// console.log(2)", "console-log-left", [1]),
    ("commented code", "a.py", "# import os\n# words only", "commented-out-code", [1]),
    ("unbounded", "a.js", "db.find({ })\ndb.find({a: 1})\nSELECT * FROM t ;", "unbounded-query", [1, 3]),
    ("create table", "a.py", "CREATE TABLE t (a int);", "no-index-hint", [1]),
    ("jwt", "a.js", "jwt.sign(user, 'longsecret')", "jwt-secret-hardcoded", [1]),
    ("bcrypt", "a.js", "bcrypt.hash(p, 5)\nbcrypt.hash(p, 10)", "bcrypt-low-rounds", [1]),
    ("debug", "a.py", "DEBUG = True", "debug-mode-production", [1]),
    ("rate limit", "a.js", "app.get('/', h)\napp.get('/', rateLimit, h)", "api-no-rate-limit", [1]),
    ("validation", "a.py", "x = request.json\ny = schema(request.json)", "api-no-input-validation", [1]),
    ("stack", "a.js", "res.json(err)", "api-error-leaks-stack", [1]),
    ("auth", "a.js", "router.delete('/x', h)\nrouter.delete('/x', auth, h)", "api-no-auth-check", [1]),
    ("abort", "a.js", "new XMLHttpRequest()", "browser-no-abort-controller", [1]),
    ("dom ready", "a.js", "document.getElementById('x')", "browser-document-ready-check", [1]),
    ("storage try", "a.js", "localStorage.getItem('x')\ntry { localStorage.getItem('x') }", "browser-localstorage-no-try", [1]),
    ("setState", "a.tsx", "setCount(1)\nonClick={() => setCount(1)}", "react-setstate-in-render", [1]),
    ("setState outside jsx", "a.ts", "setCount(1)", "react-setstate-in-render", []),
    ("index key", "src/a.jsx", "xs.map((x, i) => <li key={i}/>)", "react-array-index-key", [1]),
    ("no deps", "a.tsx", "useEffect(() => { run() });", "react-missing-dep-array", [1]),
    ("global map", "a.js", "let cache = new Map()\n  let inner = new Map()", "serverless-global-map", [1]),
    ("global set", "a.js", "var seen = new Set()", "serverless-global-set", [1]),
    ("pool", "a.py", "c = new Pool (x)", "serverless-connection-no-reuse", [1]),
    ("tmp", "a.ts", "open('/tmp/x')", "lambda-tmp-cleanup", [1]),
    ("unicode word", "a.js", "let été = new Map()", "serverless-global-map", [1]),
]


@pytest.fixture(scope="module")
def found(spark):
    from sievework.sources.files import file_table

    rows = [(f"case{i}", path, content) for i, (_, path, content, _, _) in enumerate(CASES)]
    table = file_table(spark.createDataFrame(rows, "project string, path string, content string"))
    detectors = [*security_detectors(), *loop_detectors(), *pack_detectors()]
    hits = line_findings(table, detectors).select("project", "rule_id", "line_no").collect()
    out = {}
    for r in hits:
        out.setdefault((r.project, r.rule_id), []).append(r.line_no)
    return out


@pytest.mark.parametrize("i", range(len(CASES)), ids=[c[0] for c in CASES])
def test_case(found, i):
    _, _, _, rule, lines = CASES[i]
    assert sorted(found.get((f"case{i}", rule), [])) == lines


def test_evidence_is_stripped_and_cut(files):
    hits = line_findings(files({"a.py": "\t  x = eval(" + "y" * 300 + ")  "}), security_detectors())
    assert hits.first().evidence == ("x = eval(" + "y" * 300)[:200]


def test_hints_are_implied(spark):
    """A hint may only skip lines the regex does not match."""
    import re

    from sievework.operators.security import LOWER_HINTS, SECURITY_RULES
    from sievework.sources.rules import BUILT_IN

    samples = [line for _, _, content, _, _ in CASES for line in content.split("\n")]
    for rule_id, _, _, _, ignore, regexes, hints in SECURITY_RULES:
        for rx in regexes:
            for line in samples:
                if re.search(rx, line, re.I if ignore else 0):
                    assert not hints or any(h in line for h in hints)
                    assert rule_id not in LOWER_HINTS or any(h in line.lower() for h in LOWER_HINTS[rule_id])
    for rule in (r for pack in BUILT_IN.values() for r in pack):
        for line in samples:
            if re.search(rule["regex"], line):
                assert any(h in line for h in rule["hints"])


def test_rule_checks():
    ok = {"id": "a", "pattern": "run($CMD, 1)", "severity": "error", "category": "nope"}
    spec = check_rule(ok)
    assert (spec.severity, spec.category, spec.message) == ("critical", "logic", "a")
    assert check_rule({"id": "b", "regex": "x", "severity": "odd"}).severity == "major"
    bad = [{"id": "c"}, {"id": "d", "regex": "x" * 501}, {"id": "e", "regex": "(.*)*"}, {"id": "f", "regex": "("}]
    out = check_rules(bad)
    assert not out.rules and len(out.errors) == 4
    assert len(SECURITY) == 3


def test_wildcard_pattern_and_globs(files):
    specs = [
        check_rule({"id": "w", "pattern": "run($CMD, 1)"}),
        check_rule({"id": "g", "regex": "x", "files": ["lib/*.py", "[ab].js"]}),
    ]
    table = files({"lib/sub/m.py": "run(abc, 1)\nrun(a b, 1) x", "b.js": "x", "c.js": "x"})
    hits = line_findings(table, pack_detectors(specs))
    assert sorted((r.rule_id, r.file, r.line_no) for r in hits.collect()) == [
        ("g", "b.js", 1), ("g", "lib/sub/m.py", 2), ("w", "lib/sub/m.py", 1),
    ]


def test_java_spelling(files):
    specs = [check_rule({"id": "j", "regex": r"[[&&x]y(?P<n>\d)\Z"})]
    assert specs[0].regex == java_regex(r"[[&&x]y(?P<n>\d)\Z") == r"[\[\&\&x]y(?<n>\d)\z"
    assert line_findings(files({"a.py": "[y1\n&y2\nzy3"}), pack_detectors(specs)).count() == 2


def test_rule_files(tmp_path):
    (tmp_path / "a.json").write_text('{"rules": [{"id": "one", "regex": "x"}, {"id": "two"}]}')
    (tmp_path / "b.json").write_text("{not json")
    out = load_rule_dirs([str(tmp_path)], with_built_in=False)
    assert [r.rule_id for r in out.rules] == ["one"]
    assert len(out.errors) == 2
    assert len(load_rule_dirs([]).rules) == 22


def test_dollar_braces_are_not_session_variables(spark, files):
    from pyspark.sql import functions as F

    from sievework.functions.predicates import text

    odd = "a${n}'\\\\'\\n$\\{b} \"x\" ${env:HOME}"
    spark.conf.set("spark.sql.variable.substitute", "true")
    try:
        assert spark.range(1).select(F.expr(text(odd))).first()[0] == odd
        rule = check_rule({"id": "v", "pattern": "${n}"})
        assert line_findings(files({"a.js": "`${n}`"}), pack_detectors([rule])).count() == 1
    finally:
        spark.conf.set("spark.sql.variable.substitute", "false")


def test_user_rules_are_compiled_by_java(spark, files):
    """Group names with underscores, open lower bounds and back references match; a broken rule is listed, not fatal."""
    from sievework.operators.packs import pack_findings
    from sievework.sources.rules import check_rules

    rules = check_rules(
        [
            {"id": "named", "regex": r"(?P<my_name>ab)-(?P=my_name)"},
            {"id": "open", "regex": r"x{,2}yz"},
            {"id": "python-only", "regex": r"(?P<a>b)(?(a)c|d)"},
        ],
        "user",
    )
    assert [r.rule_id for r in rules.rules] == ["named", "open"]
    assert [s for s, _ in rules.errors] == ["user"]
    found = pack_findings(files({"a.js": "ab-ab\nab-ac\nxxyz"}), rules.rules).collect()
    assert sorted((r.rule_id, r.line_no) for r in found) == [("named", 1), ("open", 3)]
