"""Rules found through the literal index equal the rules written into the plan."""

import re

import pytest

from sievework.operators.packs import pack_findings
from sievework.operators.security import SECURITY_RULES
from sievework.operators.ruletable import rule_table, table_findings
from sievework.plans import fixtures as fx
from sievework.sources.files import file_table
from sievework.sources.literals import BLANKS, needles, signs
from sievework.sources.rules import BUILT_IN, built_in, check_rules

RAW = "rule_no long, id string, regex string, pattern string, `regex-not` string, languages array<string>, files array<string>, severity string, category string, message string"
COLUMNS = ["project", "file", "line_no", "rule_id", "severity", "category", "title", "description", "evidence", "confidence", "engine", "ord"]

RULES = [
    {"id": "a", "regex": r"ev[ai]l\s*\("}, {"id": "b", "regex": r"TODO|FIXME|XXX", "severity": "info"},
    {"id": "c", "regex": r"\bfoo(?:bar|baz)+", "regex-not": r"allowed|ok", "severity": "error"},
    {"id": "d", "regex": r"^\s*#", "languages": ["python"]}, {"id": "e", "regex": r"(?i)password"},
    {"id": "f", "pattern": "eval($X)"}, {"id": "g", "regex": r"a.c"}, {"id": "h", "regex": r"x{3}y?zz", "files": ["src/*.py", "lib/[a-c]*"]},
    {"id": "i", "regex": r"(?P<q>['\"])abc(?P=q)"}, {"id": "j", "regex": r"naïve\s+日本"}, {"id": "k", "regex": r"(.*)*bad"},
    {"id": "l", "regex": r"(?:ab|cd){2}ef"}, {"id": "m"}, {"id": "n", "regex": r"unclosed("}, {"id": "o", "regex": r"(a)?(?(1)bcd|efg)"},
    {"id": "p", "regex": r"def\s", "languages": ["cobol"]}, {"id": "q", "regex": r"def\s+\w+", "languages": ["ruby", "python"]},
    {"id": "r", "regex": r"[xyz]12[34]"}, {"id": "s", "regex": r"(?=look)look(?!out)"}, {"id": "t", "regex": r"q?w?"}, {"id": "u", "regex": r"(?a)abc"},
]
LINES = [
    "evil(", "eval (x)  # TODO: fix", "foobarbaz allowed", "  foobazbar", "# note", "PassWord = 1", "eval(payload)", "abc axc", "xxxyzz xxxzz",
    "'abc' \"abc'", "naïve  日本語", "ababef cdabef abef", "bad", "def go(self):", "y123 z124 x125", "lookout looking", "", "XXX FIXME " * 200 + "evil(",
]


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def raw_table(spark, rules):
    names = ["id", "regex", "pattern", "regex-not", "languages", "files", "severity", "category", "message"]
    return spark.createDataFrame([(i, *[r.get(n) for n in names]) for i, r in enumerate(rules)], RAW)


def test_table_equals_list(spark, files):
    table = files([("p", path, "\n".join(LINES[i:] + LINES[:i])) for i, path in enumerate(
        ["src/a.py", "lib/bb.js", "lib/z.ts", "x.go", "y.rb", "deep/src/q.py", "n.txt", "lib/a/c.rs"]
    )])
    checked = rule_table(raw_table(spark, RULES))
    errors = {r.rule_id: r.error for r in checked.where("error IS NOT NULL").collect()}
    assert set(errors) == {"k", "m", "n", "o", "p", "u"}
    usable = [r for r in RULES if r["id"] not in errors]
    specs = check_rules(usable).rules
    assert len(specs) == len(usable)
    want = {r["id"]: i for i, r in enumerate(RULES)}
    got = rows(table_findings(table, checked))
    listed = [(*r[:-1], want[r[3]]) for r in rows(pack_findings(table, specs))]
    assert got == sorted(listed, key=repr)
    assert len(got) > 80


def test_built_in_packs_as_a_table(spark, sf_code):
    raws = [r for pack in BUILT_IN.values() for r in pack]
    got = rows(table_findings(sf_code, rule_table(raw_table(spark, raws))))
    assert got == rows(pack_findings(sf_code, built_in()))


@pytest.fixture
def sf_code(spark):
    return fx.code_files(spark, "/root/testdata/sf0.001")


def test_thousands_of_rules_and_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text IS NOT NULL")
    plain = file_table(docs.selectExpr("source AS project", "'f' || doc_id || '.js' AS path", "text AS content"))
    lines = [(f.project, f.path, f.ext, n, line) for f in plain.collect() for n, line in enumerate(f.content.split("\n"), 1)]
    pairs = sorted({p for *_, line in lines for p in zip(line.split(" "), line.split(" ")[1:], strict=False) if all(p)})
    pairs = pairs[:: len(pairs) // 5000][:5000]
    rules = [{"id": f"r{i}", "regex": re.escape(a) + r"\s+" + re.escape(b)} for i, (a, b) in enumerate(pairs)]
    assert len(rules) == 5000
    found = table_findings(plain, rule_table(raw_table(spark, rules)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    tests = [(r["id"], re.compile(r["regex"])) for r in rules]
    want = sorted((p, f, n, i) for p, f, _, n, line in lines for i, t in tests if t.search(line))
    assert sorted((r.project, r.file, r.line_no, r.rule_id) for r in found.collect()) == want


def test_every_match_holds_a_literal_of_each_set():
    for rule in [*RULES, *[r for pack in BUILT_IN.values() for r in pack]]:
        regex = rule.get("regex")
        if not regex or rule["id"] in ("k", "n", "o", "u"):
            continue
        sets = needles(regex)
        for line in [*LINES, *fx.TEMPLATES]:
            if re.search(regex, line):
                assert all(any(n in line for n in some) for some in sets), (regex, line)
    assert needles(r"(?:^|[ \t])st[ \t]+it(?:[ \t]|$)") == [["st\t", "st "], ["\tit", " it"]]
    assert needles(r"new\s+(?:Client|Pool)\s*\(") == [["Client", "Pool"], ["new"]]
    assert needles(r"foo(bar|baz)+qux") == [["foobar", "foobaz"], ["barqux", "bazqux"]]
    assert needles(r"(?i)abc") == needles(r"a.b") == needles(r"(?:abc|de)?") == []


def test_empty_tables(spark, files):
    none = files({"a.py": "x"}).limit(0)
    assert table_findings(none, rule_table(raw_table(spark, RULES))).count() == 0
    assert table_findings(files({"a.py": "evil("}), rule_table(raw_table(spark, []))).count() == 0
    only = spark.createDataFrame([(0, "evil")], "rule_no long, regex string")
    assert [r.rule_id for r in table_findings(files({"a.py": "evil("}), rule_table(only)).collect()] == ["custom-rule"]


def test_equal_regexes_are_tried_once(spark, files):
    rules = [{"id": f"r{i}", "regex": "a.c"} for i in range(300)]
    found = table_findings(files({"a.py": "abc\nxyz\nabc"}), rule_table(raw_table(spark, rules)))
    assert "a.c" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.line_no, r.ord) for r in found.collect()) == [(n, i) for n in (1, 3) for i in range(300)]


def test_findings_are_made_by_the_last_join(spark, files):
    rules = [{"id": f"r{i}", "regex": r"alpha\s+beta"} for i in range(30)]
    found = table_findings(files({"a.py": "alpha  beta\n" * 40}), rule_table(raw_table(spark, rules)))
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert "chunk" in joins[0]  # lines and places have met before
    assert found.count() == 40 * 30


def test_literals_of_spaced_lines(spark):
    assert needles(r"(?:^|[ \t])st[ \t]+it(?:[ \t]|$)", spaced=True) == [[" st it "]]
    assert needles(r"if\s*\(ok", spaced=True) == [["if (ok", "if(ok"]]
    assert needles(r"(?i)abc", spaced=True) == needles(r"a.b", spaced=True) == []
    for rule in [*RULES, *[r for pack in BUILT_IN.values() for r in pack]]:
        if rule.get("regex") and rule["id"] not in ("k", "n", "o", "u"):
            for line in [*LINES, *fx.TEMPLATES]:
                if re.search(rule["regex"], line):
                    flat = re.sub(f"[{BLANKS}]+", " ", f" {line} ")
                    assert all(any(n in flat for n in some) for some in needles(rule["regex"], spaced=True)), (rule, line)
    java = spark.range(0x10000).where("id NOT BETWEEN 55296 AND 57343").selectExpr("id", "decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE') AS c")
    blank = {r.id for r in java.where(r"c RLIKE '(?U)^\\s$'").collect()}
    assert blank == {i for i in range(0x10000) if re.match(f"[{BLANKS}]", chr(i))}


def test_white_space_and_long_lines(spark, files):
    long = "word " * 60_000
    lines = ["  alpha beta", "alpha\tbeta", "alpha\u2003\xa0 beta ", "alphabeta", "alpha  bet", "x alpha \t beta.", long + "alpha beta", long + "beta", " beta "]
    rules = [
        {"id": "a", "regex": r"alpha\s+beta"}, {"id": "b", "regex": r"^\s*alpha[ \t]+beta"}, {"id": "c", "regex": r"(?:^|[ \t])beta(?:[ \t]|$)"},
        {"id": "d", "regex": r"alpha\s*beta$"}, {"id": "e", "regex": r"word +alpha"}, {"id": "f", "regex": r"alpha {2}bet"},
    ]
    table = files([("p", f"{i}.js", line) for i, line in enumerate(lines)])
    got = rows(table_findings(table, rule_table(raw_table(spark, rules))))
    assert got == rows(pack_findings(table, check_rules(rules).rules))
    assert len(got) > 15


def test_rules_that_share_a_number(spark, files):
    raw = [(7, "x", "alpha\\s+beta"), (7, "y", "gamma"), (7, "y", "gamma"), (8, "z", "delta"), (None, "n", "alpha")]
    rules = rule_table(spark.createDataFrame(raw, "rule_no long, id string, regex string"))
    lots = "\n".join(f"line {i}" for i in range(200))
    found = table_findings(files({"a.py": f"alpha beta\n{lots}\ngamma\ndelta"}), rules)
    got = sorted((r.line_no, r.rule_id) for r in found.collect())
    assert got == sorted([(1, "n"), *[(1, i) for i in "xyy"], *[(202, i) for i in "xyyxyy"], (203, "z")])


def test_signs_are_in_every_match():
    assert signs(r"eval\s*\(") == "(" and signs(r"a\(b=|c\(", r"(?:x|\.y)\(") == "("
    assert signs(r"[=:]x") == signs(r"(?:\()?x") == signs(r"a(?=\()") == signs(r"(?i)eval\(") == signs("") == ""
    regexes = [(x, False) for rule in RULES for x in [rule.get("regex")] if x and rule["id"] not in ("k", "n", "o", "u")]
    regexes += [(r["regex"], False) for pack in BUILT_IN.values() for r in pack if r.get("regex")]
    regexes += [(x, ignore) for *_, ignore, several, _ in SECURITY_RULES for x in several]
    for regex, ignore in regexes:
        for line in [*LINES, *fx.TEMPLATES]:
            if re.search(regex, line, re.IGNORECASE if ignore else 0):
                assert all(c in line for c in signs(regex)), (regex, line)
