"""DuckDB SQL with the answers the queries must give.

Written against whole lines and whole tables, without the short cuts the Spark plans take.
"""

from __future__ import annotations

from sievework.operators import deep, imports, loops, persona, security
from sievework.operators.index import (
    JS_CLASS, JS_FUNCTION, JS_IMPORT, JS_STATE, JS_STATE_SKIP, PY_CLASS, PY_FUNCTION, PY_IMPORT,
    PY_STATE, PY_STATE_SKIP,
)
from sievework.operators.lines import GUARD, LOOP_OPEN
from sievework.plans.fixtures import ALIVE, ELSEWHERE, LEAST_LARGE, MANIFESTS, PLACES, RULE_KINDS, SHIFT, SLOTS, SNIPPETS, STYLES, TEMPLATES, TOP
from sievework.sources.rules import BUILT_IN, LANGUAGE_EXTS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def isin(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def has(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def rx(col: str, pattern: str, ignore_case: bool = False) -> str:
    # RE2 has no look-around: the three patterns that use it get an equal spelling
    pattern = pattern.replace(r"""(?!['"\d])""", r"""(?:[^'"\d]|$)""").replace(r"(?<!\.)fetch", r"(?:^|[^.])fetch")
    return f"regexp_matches({col}, {q(('(?i)' if ignore_case else '') + pattern)})"


EXT = "CASE doc_id // 7 % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.tsx' ELSE '.html' END"
PATH = f"'src/' || lang || CASE WHEN doc_id % 3 = 0 THEN '/api' ELSE '' END || '/f' || doc_id || {EXT}"

_tpl = ", ".join(f"({i}, {q(t)})" for i, t in enumerate(TEMPLATES))
LINES = f"""
src AS (
  SELECT doc_id, source AS project, {PATH} AS path, {EXT} AS ext, lang,
         unnest(string_split(text, chr(10))) AS raw,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM documents),
tpl AS (SELECT * FROM (VALUES {_tpl}) v(slot, tline)),
L0 AS (
  SELECT doc_id, project, path, ext,
         CASE ext WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.tsx' THEN 'typescript' END AS language,
         CAST(line_no AS INT) AS line_no, coalesce(tline, raw) AS line
  FROM src LEFT JOIN tpl ON slot = (doc_id * 7 + line_no) % {SLOTS}),
F AS (
  SELECT project, path, ext, language, any_value(doc_id) AS doc_id, count(*) AS n,
         string_agg(line, chr(10) ORDER BY line_no) AS content
  FROM L0 GROUP BY project, path, ext, language),
SMALL AS (SELECT project, path FROM F WHERE length(content) / n > 500 AND n < 50),
"""


def at_step(answer: str, step: int) -> str:
    """``answer`` for the tree as it is at a step."""
    for old, new in (
        ("(doc_id * 7 + line_no)", f"(doc_id * 7 + ({SHIFT[step]}) + line_no)"), (f"{PATH} AS path", PATH.replace("'src/'", TOP[step], 1) + " AS path"),
        ("generate_subscripts(string_split(text, chr(10)), 1) AS line_no\n  FROM documents)",
         f"generate_subscripts(string_split(text, chr(10)), 1) AS line_no\n  FROM documents WHERE {ALIVE[step]})"),
    ):
        assert answer.count(old) == 1, old
        answer = answer.replace(old, new)
    # the Python files, which neither change nor move
    for old, new in (
        ("FROM documents WHERE doc_id % 11 <> 0)", f"FROM documents WHERE doc_id % 11 <> 0 AND {ALIVE[step]})"),
        ("chr(10)) AS ls\n  FROM documents)", f"chr(10)) AS ls\n  FROM documents WHERE {ALIVE[step]})"),
    ):
        answer = answer.replace(old, new)
    return answer


# every line / only lines of source files (known extension, not minified)
ALL_LINES = LINES + "L AS (SELECT * FROM L0)"
SOURCE_LINES = LINES + (
    "L AS (SELECT * FROM L0 WHERE ext <> '.html' AND (project, path) NOT IN (SELECT (project, path) FROM SMALL))"
)
CODE_LINES = LINES + "L AS (SELECT * FROM L0 WHERE ext <> '.html')"

OVER = "OVER (PARTITION BY project, path ORDER BY line_no ROWS BETWEEN {} AND {})"


def frame(before: int, after: int) -> str:
    lo = f"{before} PRECEDING" if before >= 0 else f"{-before} FOLLOWING"
    return OVER.format(lo, f"{after} FOLLOWING")


STRIP = "regexp_replace(line, '^\\s+|\\s+$', '', 'g')"
BLOCK = f"""
B0 AS (
  SELECT *, CASE WHEN contains(line, '/*') AND NOT contains(line, '*/') THEN true
                 WHEN contains(line, '*/') AND NOT contains(line, '/*') THEN false END AS ev FROM L),
B AS (
  SELECT *, coalesce(last_value(ev IGNORE NULLS) {OVER.format('UNBOUNDED PRECEDING', '1 PRECEDING')}, false) AS in_block
  FROM B0)
"""

COMMENT_STATE = f"""WITH {ALL_LINES}, {BLOCK}
SELECT project, path AS file, line_no, in_block FROM B"""

_bound = has("line", ["placeholders", "params", ", vals"]) + " OR contains(upper(line), 'VALUES (')"
_names = has("line", ["for table in", "for col in"]) + " OR regexp_matches(line, 'col\\s*=\\s*[\"'']')"
SECURITY = f"""
S0 AS (
  SELECT *, bool_or(contains(line, '?')) {frame(24, 10)} AS mark,
         bool_or({_bound}) {frame(24, 10)} AS bound,
         bool_or({_names}) {frame(24, 10)} AS named FROM B),
S1 AS (
  SELECT *, (mark AND bound) OR named AS safe, {STRIP} AS stripped FROM S0
  WHERE NOT in_block AND NOT contains(line, '/*')
    AND NOT regexp_matches(line, '^\\s*(#|//|\\*)') AND NOT {has('line', ['re.compile', 'Pattern'])}
    AND NOT regexp_matches(line, '^\\s*("|''|f'')') AND NOT contains(line, '\"\"\"') AND NOT contains(line, '''''''')),
"""


def _security_rules() -> str:
    parts = []
    for rule_id, exts, severity, title, ignore, regexes, _ in security.SECURITY_RULES:
        test = "(" + " OR ".join(rx("line", r, ignore) for r in regexes) + ")"
        if rule_id == "unsafe-yaml":
            test = (
                rx("line", r"yaml\.load\s*\([^)]*\)")
                + " AND NOT " + rx("line", r"yaml\.load\s*\([^)]*\).*Loader")
            )
        named = q(title)
        if rule_id == "sql-injection":
            named = f"CASE WHEN {rx('line', regexes[0])} THEN {q(title)} ELSE {q(security.SQL_CONCAT_TITLE)} END"
        cond = [test]
        if exts:
            cond.append(f"ext IN {isin(exts)}")
        if rule_id in ("hardcoded-secret", "hardcoded-password"):
            cond.append("NOT " + has("line", security.SAFE_SOURCES))
        if rule_id.startswith("sql-injection"):
            cond.append("NOT safe")
        parts.append(
            f"SELECT project, path AS file, line_no, {q(rule_id)} AS rule_id, {q(severity)} AS severity, "
            f"'security' AS category, {named} AS title, left(stripped, 200) AS evidence FROM S1 WHERE {' AND '.join(cond)}"
        )
    return "\nUNION ALL ".join(parts)


def security_cte(lines: str = "L") -> str:
    return f"{BLOCK}, {SECURITY} SEC AS ({_security_rules()})"


SECURITY_FINDINGS = f"WITH {ALL_LINES}, {security_cte()} SELECT * EXCLUDE (category) FROM SEC"

_hit = rx("line", LOOP_OPEN)
LOOPS = f"""
D0 AS (
  SELECT *, CASE WHEN {_hit} THEN 1 ELSE 0 END AS o, length(line) - length(replace(line, '}}', '')) AS c
  FROM L WHERE ext IN ('.js', '.tsx')),
D1 AS (SELECT *, sum(o - c) {OVER.format('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS s FROM D0),
D2 AS (SELECT *, s - least(0, min(s) {OVER.format('UNBOUNDED PRECEDING', 'CURRENT ROW')}) AS d FROM D1),
D AS (SELECT *, coalesce(lag(d) OVER (PARTITION BY project, path ORDER BY line_no), 0) + o AS depth FROM D2),
LOOPF AS (
  SELECT project, path AS file, line_no, 'fetch-in-loop' AS rule_id, 'major' AS severity, 'performance' AS category,
         'HTTP request in loop' AS title, CAST(NULL AS VARCHAR) AS evidence
  FROM D WHERE depth > 0 AND {rx('line', loops.FETCH)}
  UNION ALL SELECT project, path, line_no, 'dom-in-loop', 'minor', 'performance', 'DOM query in loop', NULL
  FROM D WHERE depth > 0 AND contains(line, 'document.querySelector')
  UNION ALL SELECT project, path, line_no, 'sync-io', 'minor', 'performance', 'Synchronous file I/O', NULL
  FROM D WHERE {rx('line', loops.SYNC)})
"""
LOOP_FINDINGS = f"WITH {CODE_LINES}, {LOOPS} SELECT project, file, line_no, rule_id, severity FROM LOOPF"


def _pack_rules(names) -> str:
    parts = []
    for name in names:
        for r in BUILT_IN[name]:
            cond = [rx("line", r["regex"])]
            if r.get("regex-not"):
                cond.append("NOT " + rx("line", r["regex-not"]))
            exts = [e for lang in r.get("languages", []) for e in LANGUAGE_EXTS[lang]]
            cond.append(f"ext IN {isin(exts or ['.py', '.js', '.tsx'])}")
            if r.get("files"):
                cond.append("(" + " OR ".join(f"path GLOB {q(g)}" for g in r["files"]) + ")")
            parts.append(
                f"SELECT project, path AS file, line_no, {q(r['id'])} AS rule_id, {q(r['severity'])} AS severity, "
                f"{q(r['category'])} AS category, {q(r['message'])} AS title, left({STRIP}, 200) AS evidence "
                f"FROM L WHERE {' AND '.join(cond)}"
            )
    return "\nUNION ALL ".join(parts)


def pack_findings(*names: str) -> str:
    return f"WITH {CODE_LINES}, P AS ({_pack_rules(names)}) SELECT * EXCLUDE (category) FROM P"


_number = "CAST(substr(project, 4) AS INT)"
PROJECTS = "PRJ AS (SELECT DISTINCT source AS project FROM documents)"
PACKAGES = f"""
{PROJECTS},
NPM AS (
  SELECT project, 'express' AS name FROM PRJ WHERE {_number} % 4 <> 0
  UNION SELECT project, unnest(['react', 'express', '@prisma/client']) FROM PRJ WHERE {_number} % 3 = 0
  UNION SELECT project, 'left-pad-ultra' FROM PRJ WHERE {_number} % 3 = 1),
PYPI AS (SELECT project, 'quantum_widget' AS name FROM PRJ WHERE {_number} % 3 = 0)
"""
_specs = (
    f"list_concat(regexp_extract_all(line, {q(imports.FROM_IMPORT)}, 1), "
    f"regexp_extract_all(line, {q(imports.REQUIRE)}, 1))"
)
JS_IMPORTS = f"""
I0 AS (SELECT project, path, line_no, {_specs} AS specs FROM L WHERE ext IN ('.js', '.tsx')),
I1 AS (SELECT project, path, line_no, unnest(specs) AS spec, generate_subscripts(specs, 1) AS seq FROM I0),
I2 AS (
  SELECT *, CASE WHEN starts_with(spec, '@') THEN array_to_string(string_split(spec, '/')[1:2], '/')
                 ELSE split_part(spec, '/', 1) END AS package FROM I1),
JSI AS (
  SELECT * FROM I2
  WHERE package NOT IN {isin(imports.RUNTIME_MODULES)}
    AND NOT (starts_with(package, 'node:') OR starts_with(package, '@/') OR starts_with(package, '~/') OR starts_with(package, '#/'))
    AND NOT EXISTS (SELECT 1 FROM NPM WHERE NPM.project = I2.project AND NPM.name = I2.package)),
JSF AS (
  SELECT project, path AS file, line_no, 'hallucinated-import' AS rule_id, 'critical' AS severity, 'import' AS category,
         'Hallucinated import: ' || arg_min(spec, seq) AS title,
         'Import ''' || arg_min(spec, seq) || ''' not found in installed javascript packages' AS evidence
  FROM JSI GROUP BY project, path, line_no)
"""
JS_IMPORT_FINDINGS = f"WITH {CODE_LINES}, {PACKAGES}, {JS_IMPORTS} SELECT * EXCLUDE (category) FROM JSF"

# ---- Python files: what each snippet holds, by line inside the snippet
_counts = ", ".join(f"({i}, {s.count(chr(10))})" for i, s in enumerate(SNIPPETS))
PY = f"""
SN AS (SELECT * FROM (VALUES {_counts}) v(snip, n)),
DOC AS (
  SELECT doc_id, source AS project, 'app/' || lang || '/m' || doc_id || '.py' AS file, lang,
         doc_id % 8 AS a, (doc_id + 3) % 8 AS b, (doc_id + 5) % 8 AS c
  FROM documents WHERE doc_id % 11 <> 0),
PLACED AS (
  SELECT project, file, lang, a AS snip, 0 AS off FROM DOC
  UNION ALL SELECT project, file, lang, b, sa.n FROM DOC JOIN SN sa ON sa.snip = a
  UNION ALL SELECT project, file, lang, c, sa.n + sb.n FROM DOC JOIN SN sa ON sa.snip = a JOIN SN sb ON sb.snip = b)
"""
_ast_answers = """
  (1, 1, 2, 'nested-loop-on2', 'major', 'Potential O(n²) nested loop'),
  (3, 2, NULL, 'io-in-loop', 'major', 'I/O operation in loop: requests.get'),
  (3, 3, NULL, 'concat-in-loop', 'minor', 'Concatenation in loop'),
  (4, 3, NULL, 'io-in-loop', 'major', 'I/O operation in loop: f.read'),
  (4, 4, NULL, 'concat-in-loop', 'minor', 'Concatenation in loop'),
  (5, 2, 4, 'nested-loop-on2', 'major', 'Potential O(n²) nested loop'),
  (5, 5, NULL, 'io-in-loop', 'major', 'I/O operation in loop: open'),
  (7, 3, NULL, 'io-in-loop', 'major', 'I/O operation in loop: spread')
"""
AST_FINDINGS = f"""WITH {PY},
ANS AS (SELECT * FROM (VALUES {_ast_answers}) v(snip, rel, rel_end, rule_id, severity, title))
SELECT project, file, CAST(off + rel AS INT) AS line_no, CAST(off + rel_end AS INT) AS end_line, rule_id, severity, title
FROM PLACED JOIN ANS USING (snip)"""
PY_IMPORT_FINDINGS = f"""WITH {PACKAGES}, {PY},
ANS AS (SELECT * FROM (VALUES (0, 3, 'quantum_widget.core', 'quantum_widget'), (6, 1, 'flaskish.app', 'flaskish')) v(snip, rel, module, root)),
LOCALS AS (SELECT DISTINCT source AS project, lang FROM documents WHERE doc_id % 50 = 0)
SELECT p.project, file, CAST(off + rel AS INT) AS line_no, 'Hallucinated import: ' || module AS title
FROM PLACED p JOIN ANS USING (snip)
WHERE NOT EXISTS (SELECT 1 FROM PYPI WHERE PYPI.project = p.project AND PYPI.name = root)
  AND NOT (root = 'flaskish' AND EXISTS (SELECT 1 FROM LOCALS l WHERE l.project = p.project AND l.lang = p.lang))"""

_pick = "CASE ({}) % 8 " + " ".join(f"WHEN {i} THEN {q(t)}" for i, t in enumerate(SNIPPETS)) + " END"
_COMMENT = "'# ' || replace(replace(text, chr(13), ' '), chr(10), chr(10) || '# ')"
_CONTENT = (
    f"{_pick.format('doc_id')} || {_pick.format('doc_id + 3')} || {_pick.format('doc_id + 5')} "
    f"|| CASE WHEN doc_id % 11 = 0 THEN {q('def broken(:' + chr(10))} ELSE '' END || {_COMMENT}"
)
#: The Python files' lines beside those of the other files, and what their parsing finds.
PY_LINES = f"""{PY},
PYC AS (
  SELECT doc_id, source AS project, 'app/' || lang || '/m' || doc_id || '.py' AS path, string_split({_CONTENT}, chr(10)) AS ls
  FROM documents),
L0 AS (
  SELECT * FROM LT
  UNION ALL SELECT doc_id, project, path, '.py', 'python', CAST(generate_subscripts(ls, 1) AS INT), unnest(ls) FROM PYC),
"""
PY_FOUND = f"""
PYA AS (SELECT * FROM (VALUES {_ast_answers}) v(snip, rel, rel_end, rule_id, severity, title)),
PYI AS (SELECT * FROM (VALUES (0, 3, 'quantum_widget.core', 'quantum_widget'), (6, 1, 'flaskish.app', 'flaskish')) v(snip, rel, module, root)),
PYF0 AS (
  SELECT project, file, CAST(off + rel AS INT) AS line_no, rule_id, severity, 'performance' AS category, title, NULL AS evidence
  FROM PLACED JOIN PYA USING (snip)
  UNION ALL SELECT project, file, CAST(off + rel AS INT), 'hallucinated-import', 'critical', 'import', 'Hallucinated import: ' || module,
    'Import ''' || module || ''' not found in installed python packages'
  FROM PLACED p JOIN PYI USING (snip) WHERE NOT EXISTS (SELECT 1 FROM PYPI WHERE PYPI.project = p.project AND PYPI.name = root)),
PYF AS (SELECT * FROM PYF0 WHERE (project, file) NOT IN (SELECT (project, path) FROM SMALL))
"""

# ---- project context
_manifest_rows = "\nUNION ALL ".join(
    f"SELECT project, {q(name)} AS path, {q(text)} AS content FROM PRJ WHERE {_number} % {d} = {r}"
    for name, d, r, text in MANIFESTS
)
MANIFEST = f"{PROJECTS}, M AS ({_manifest_rows})"
# frameworks by manifest content, spelled out for the manifests above
CONTEXT_CTE = f"""
CX0 AS (
  SELECT project,
    bool_or(path = 'vercel.json') AS vercel, bool_or(path = 'netlify.toml') AS netlify,
    bool_or(path = 'serverless.yml') AS lambda_, bool_or(path = 'Dockerfile') AS docker, bool_or(path = 'Procfile') AS heroku,
    bool_or(path = 'vercel.json' AND contains(content, 'edge')) AS edge,
    bool_or(path = 'requirements.txt' AND contains(lower(content), 'django')) AS django,
    bool_or(path = 'requirements.txt' AND contains(lower(content), 'flask')) AS flask,
    bool_or(path = 'requirements.txt' AND contains(lower(content), 'sqlalchemy')) AS alchemy,
    bool_or(path = 'package.json' AND contains(content, '"react"')) AS react,
    bool_or(path = 'package.json' AND contains(content, '"express"')) AS express,
    bool_or(path = 'package.json' AND contains(content, '@prisma/client')) AS prisma,
    bool_or(path = 'package.json') AS pkg,
    bool_or((path = 'package.json' AND contains(content, '"bin"')) OR (path = 'pyproject.toml' AND contains(content, '[project.scripts]'))) AS cli,
    bool_or(path = 'index.html') AS page
  FROM M WHERE path NOT LIKE 'README%' GROUP BY project),
CX AS (
  SELECT project,
    CASE WHEN vercel THEN 'vercel' WHEN netlify THEN 'netlify' WHEN lambda_ THEN 'aws-lambda' WHEN docker THEN 'docker' WHEN heroku THEN 'heroku' END AS deployment,
    vercel OR netlify OR lambda_ AS is_serverless, vercel AND edge AS has_edge_runtime,
    react OR express OR flask OR django OR page AS is_web_app, cli AS is_cli, express OR flask OR django AS is_api,
    array_to_string(list_filter([CASE WHEN django THEN 'django' END, CASE WHEN flask THEN 'flask' END,
      CASE WHEN react THEN 'react' END, CASE WHEN express THEN 'express' END], lambda x: x IS NOT NULL), ',') AS frameworks,
    django OR alchemy OR prisma AS has_orm, react OR django AS has_template_escaping, django AS has_csrf_protection,
    false AS has_cors_configured,
    array_to_string(list_filter([
      CASE WHEN vercel THEN 'vercel.json' WHEN netlify THEN 'netlify.toml' WHEN lambda_ THEN 'serverless.yml' WHEN docker THEN 'Dockerfile' WHEN heroku THEN 'Procfile' END,
      CASE WHEN pkg THEN 'package.json' END], lambda x: x IS NOT NULL), ',') AS config_files
  FROM CX0)
"""
PROJECT_CONTEXT = f"WITH {MANIFEST}, {CONTEXT_CTE} SELECT * FROM CX"


def adjusted(findings: str) -> str:
    """CTE text: the severity after the context rules, from CTE ``findings``."""
    return f"""
ADJ0 AS (
  SELECT f.*, CASE
    WHEN rule_id IN ('xss-innerhtml', 'xss-react-dangerous') AND coalesce(is_cli, false) AND NOT coalesce(is_web_app, false) THEN 'suppress'
    WHEN rule_id = 'xss-react-dangerous' AND contains(coalesce(frameworks, ''), 'react') THEN 'minor'
    WHEN rule_id = 'sql-injection' AND coalesce(has_orm, false) THEN 'minor'
    WHEN rule_id = 'cors-wildcard' AND NOT coalesce(is_api, false) THEN 'info'
    WHEN rule_id = 'localstorage-sensitive' AND coalesce(is_cli, false) THEN 'suppress' END AS adj
  FROM {findings} f LEFT JOIN CX USING (project)),
ADJ AS (SELECT * REPLACE (coalesce(adj, severity) AS severity) FROM ADJ0 WHERE adj IS DISTINCT FROM 'suppress')
"""


def _scan_cte(severities=("critical", "major", "minor", "info"), rules: bool = True) -> str:
    # detectors run on source files that are not minified, packs on all source files
    packs = f"UNION ALL SELECT * FROM ({_pack_rules(BUILT_IN).replace('FROM L ', 'FROM L0 ')})" if rules else ""
    packs = packs.replace("WHERE ", "WHERE ext <> '.html' AND ")
    lines = SOURCE_LINES.replace("L0 AS (", "LT AS (", 1).replace("F AS (", PY_LINES + "F AS (", 1)
    return f"""{lines}, {security_cte()}, {LOOPS}, {PACKAGES}, {JS_IMPORTS}, {PY_FOUND},
M AS ({_manifest_rows}), {CONTEXT_CTE},
ALLF AS (
  SELECT * FROM (SELECT * FROM SEC UNION ALL SELECT * FROM LOOPF UNION ALL SELECT * FROM JSF UNION ALL SELECT * FROM PYF) WHERE severity IN {isin(severities)}
  {packs}),
{adjusted('ALLF')}"""


SCAN_FINDINGS = f"""WITH {_scan_cte()}
SELECT project, file, line_no, rule_id, severity, category, title, evidence FROM ADJ"""
_prints = "SELECT project, severity, rule_id || ':' || coalesce(file, 'None') || ':' || coalesce(line_no::VARCHAR, 'None') AS fp FROM {}"
_counted = "SELECT project, count(*) AS n, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'major') AS m FROM {} GROUP BY project"
#: Both scans whole: what an incremental scan takes over must not show.
INCREMENTAL_DELTA = f"""
WITH s3 AS ({at_step(SCAN_FINDINGS, 3)}), s2 AS ({at_step(SCAN_FINDINGS, 2)}),
now AS ({_prints.format('s3')}), old AS ({_prints.format('s2')}),
P AS (SELECT DISTINCT source AS project FROM documents WHERE {ALIVE[2]}),
Q AS (SELECT DISTINCT source AS project FROM documents WHERE {ALIVE[3]}),
CN AS ({_counted.format('now')}), CO AS ({_counted.format('old')}),
NEW AS (SELECT project, count(*) AS k FROM now ANTI JOIN old USING (project, fp) GROUP BY project),
FIXED AS (SELECT project, count(*) AS k FROM old ANTI JOIN now USING (project, fp) GROUP BY project)
SELECT project, 3::BIGINT AS current_scan, 2::BIGINT AS previous_scan, coalesce(CN.n, 0) - coalesce(CO.n, 0) AS delta_total,
       coalesce(CN.c, 0) - coalesce(CO.c, 0) AS delta_critical, coalesce(CN.m, 0) - coalesce(CO.m, 0) AS delta_major,
       coalesce(NEW.k, 0) AS new_issues, coalesce(FIXED.k, 0) AS fixed_issues
FROM P JOIN Q USING (project) LEFT JOIN CN USING (project) LEFT JOIN CO USING (project) LEFT JOIN NEW USING (project) LEFT JOIN FIXED USING (project)
"""
SCAN_LOW = f"""WITH {_scan_cte(('critical',), rules=False)}
SELECT project, file, line_no, rule_id, severity FROM ADJ"""
ADJUSTED = f"""WITH {ALL_LINES}, {security_cte()}, {MANIFEST}, {CONTEXT_CTE}, {adjusted('SEC')}
SELECT project, file, line_no, rule_id, severity FROM ADJ"""

_counts_by = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "major", "minor", "info"))
SUMMARY_CTE = f"""
SUMMARY AS (
  SELECT project, count(*) AS total_issues, {_counts_by},
         CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN 2 WHEN count(*) FILTER (severity = 'major') > 0 THEN 1 ELSE 0 END AS gate
  FROM {{}} GROUP BY project)"""
SCAN_SUMMARY = f"""WITH {ALL_LINES}, {security_cte()}, {LOOPS},
U AS (SELECT *, 'code' AS engine FROM SEC UNION ALL SELECT *, 'code' FROM LOOPF UNION ALL SELECT *, 'rules' FROM ({_pack_rules(BUILT_IN)})),
E AS (SELECT project, string_agg(DISTINCT engine, ',' ORDER BY engine) AS engines_run FROM U GROUP BY project),
{SUMMARY_CTE.format('U')} SELECT * FROM SUMMARY JOIN E USING (project)"""
TOP_RULES = f"""WITH {ALL_LINES}, {security_cte()}
SELECT rule_id, severity, count(*) AS findings, count(DISTINCT file) AS files FROM SEC GROUP BY ALL"""

# ---- file sources
FILE_FILTER = f"""WITH {ALL_LINES}
SELECT project, path, ext, language, CAST(n AS BIGINT) AS lines, strlen(content) AS size_bytes, md5(content) AS md5
FROM F WHERE ext <> '.html' AND (project, path) NOT IN (SELECT (project, path) FROM SMALL)
  AND NOT contains(path, '/fr/') AND NOT (path GLOB '*7.js')"""
_TEXT_FILES = "SELECT source AS project, 'f' || doc_id AS path, md5(text) AS md5 FROM documents"
_STATE = """SELECT source AS project, 'f' || doc_id AS path,
  md5(CASE WHEN doc_id % 4 = 0 THEN concat(text, 'x') ELSE text END) AS md5 FROM documents WHERE doc_id % 2 = 0"""
INCREMENTAL = f"""WITH a AS ({_TEXT_FILES}), b AS ({_STATE})
SELECT a.project, a.path FROM a LEFT JOIN b USING (project, path) WHERE a.md5 IS DISTINCT FROM b.md5"""
NEXT_STATE = f"""WITH a AS ({_TEXT_FILES}), b AS ({_STATE})
SELECT project, path, coalesce(n.md5, b.md5) AS md5
FROM a n FULL JOIN b USING (project, path)"""
UNCHANGED = f"""WITH a AS ({_TEXT_FILES}), b AS ({_STATE})
SELECT project, path FROM a JOIN b USING (project, path) WHERE a.md5 = b.md5"""
CHANGED = f"""WITH {ALL_LINES}
SELECT project, path FROM F WHERE doc_id % 3 = 0 AND doc_id % 7 <> 1"""
_SEVERITY = {"error": "critical", "warning": "major"}
_KINDS = ", ".join(
    f"({j}, {'NULL' if not langs else '[' + ', '.join(q(e) for x in langs for e in LANGUAGE_EXTS[x]) + ']'}, "
    f"{q(_SEVERITY.get(severity, severity))}, {str(bool(globs)).lower()})"
    for j, (langs, globs, severity) in enumerate(RULE_KINDS)
)
#: Neighbouring words of rules and of lines meet by equality.
LARGE_RULE_TABLE = f"""
WITH {LINES}
kinds AS (SELECT * FROM (VALUES {_KINDS}) v(j, exts, severity, in_api)),
texts AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda w: w <> '') AS ws FROM documents),
rules AS (
  SELECT 'pair-' || doc_id || '-' || j AS rule_id, kinds.*, ws[len(ws) * j // 5 + 1] AS a, ws[len(ws) * j // 5 + 2] AS b,
         CASE WHEN j = 4 THEN ws[1] END AS unless
  FROM texts, kinds WHERE ws[len(ws) * j // 5 + 2] IS NOT NULL
),
tokens AS (
  SELECT project, path, ext, line_no, line, unnest(string_split_regex(line, '[ \\t]+')) AS a,
         unnest(string_split_regex(line, '[ \\t]+')[2:]) AS b
  FROM L0 WHERE ext <> '.html'
),
pairs AS (SELECT DISTINCT * FROM tokens WHERE b IS NOT NULL)
SELECT project, path AS file, line_no, rule_id, severity, 'style' AS category, rule_id AS title, left({STRIP}, 200) AS evidence
FROM pairs JOIN rules USING (a, b)
WHERE (exts IS NULL OR list_contains(exts, ext)) AND (NOT in_api OR regexp_full_match(path, 'src/.*/api/.*'))
  AND (unless IS NULL OR NOT contains(line, unless))
"""

_place = " ".join(f"WHEN doc_id % {d} = {r} THEN {p}" for d, r, p in PLACES)
REJECT_COUNTS = f"""
WITH raw AS (
  SELECT doc_id, source AS project, CASE {_place} ELSE {ELSEWHERE} END AS path,
         CASE WHEN doc_id % 5 = 0 THEN replace(text, chr(10), ' ') ELSE text END AS body
  FROM documents),
sized AS (
  SELECT *, strlen(body) + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS bytes,
         length(regexp_replace(body, '\r\n', chr(10), 'g')) AS chars, len(string_split(regexp_replace(body, '\r\n?', chr(10), 'g'), chr(10))) AS n
  FROM raw),
why AS (
  SELECT *, CASE WHEN starts_with(path, 'node_modules/') OR contains(path, '.min') OR starts_with(path, 'skip/') THEN 'ignored'
    WHEN path LIKE '%.png' THEN 'unsupported' WHEN bytes > {LEAST_LARGE} THEN 'oversize' WHEN doc_id % 13 = 0 THEN 'undecodable'
    WHEN path NOT LIKE '%.md' AND chars / n > 500 AND n < 50 THEN 'minified' END AS reason
  FROM sized)
SELECT project, reason, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM why WHERE reason IS NOT NULL GROUP BY project, reason
"""
UNPARSED = f"""
WITH PYT AS (SELECT doc_id, source AS project, 'app/' || lang || '/m' || doc_id || '.py' AS path, {_CONTENT} AS body FROM documents),
WHY AS (
  SELECT *, CASE WHEN length(body) / len(string_split(body, chr(10))) > 500 AND len(string_split(body, chr(10))) < 50 THEN 'minified'
                 WHEN doc_id % 11 = 0 THEN 'unparsed' END AS reason FROM PYT)
SELECT project, path, strlen(body)::BIGINT AS size_bytes, reason FROM WHY WHERE reason IS NOT NULL
"""

CHANGES = f"""SELECT source AS project, {PATH} AS path,
  CASE doc_id % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'D' WHEN 2 THEN 'R' ELSE 'M' END AS status,
  CASE WHEN doc_id % 7 = 2 THEN 'old/f' || doc_id END AS old_path
FROM documents WHERE doc_id % 3 = 0"""
CONFIG_FILES = f"""WITH {MANIFEST}
SELECT project, path AS name, left(content, 5000) AS content FROM M WHERE path NOT LIKE 'README%' AND path <> 'index.html'"""
READMES = f"""WITH {MANIFEST}
SELECT project, arg_min(path, CASE path WHEN 'README.md' THEN 0 ELSE 1 END) AS name,
       arg_min(content, CASE path WHEN 'README.md' THEN 0 ELSE 1 END) AS content
FROM M WHERE path LIKE 'README%' GROUP BY project"""
NPM_PACKAGES = f"""WITH {PROJECTS}
SELECT project, 'npm' AS ecosystem, unnest(['react', 'express', '@prisma/client']) AS name FROM PRJ WHERE {_number} % 3 = 0
UNION ALL SELECT project, 'npm', 'left-pad-ultra' FROM PRJ WHERE {_number} % 3 = 1
UNION ALL SELECT DISTINCT source, 'npm', unnest(['pkg' || lang, '@scope/p' || doc_id % 3]) FROM documents"""
PYPI_PACKAGES = """SELECT DISTINCT 'src' || p_size AS project, 'pypi' AS ecosystem, replace(lower(p_brand || '-' || p_type), '-', '_') AS name
FROM part"""

# ---- history
LOG = """
LOG0 AS (
  SELECT CAST(extract(day FROM ts) AS INT) AS scan_id, 'src' || user_id % 5 AS project, 'rule' || event_id % 4 AS rule_id,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE 'src/f' || user_id % 13 || CASE WHEN user_id % 2 = 0 THEN '.py' ELSE '.js' END END AS file,
    CAST(event_id % 3 AS INT) AS line,
    CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'major' WHEN 'click' THEN 'minor' ELSE 'info' END AS severity,
    CASE event_type WHEN 'error' THEN 'security' WHEN 'purchase' THEN 'performance' WHEN 'click' THEN 'ai_pattern' ELSE 'logic' END AS category,
    event_id AS seq FROM events),
LOG AS (SELECT *, rule_id || ':' || coalesce(file, 'None') || ':' || line AS fingerprint FROM LOG0),
SC AS (SELECT project, scan_id, count(*) AS total_issues, count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'minor') AS minor, count(*) FILTER (severity = 'info') AS info
  FROM LOG GROUP BY project, scan_id),
PREV AS (SELECT *, lag(scan_id) OVER (PARTITION BY project ORDER BY scan_id) AS prev_id FROM SC)
"""
SCANS = f"WITH {LOG} SELECT * FROM SC"
ISSUE_LOG = f"WITH {LOG} SELECT seq, project, scan_id, fingerprint FROM LOG"
SCAN_HISTORY = f"WITH {LOG} SELECT * FROM SC ORDER BY scan_id DESC, project LIMIT 20"
PREVIOUS_SCANS = f"WITH {LOG} SELECT project, scan_id, prev_id FROM PREV"
DELTA = f"""WITH {LOG},
R AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY scan_id DESC) AS age FROM SC),
P AS (SELECT c.project, c.scan_id AS current_scan, p.scan_id AS previous_scan,
  c.total_issues - p.total_issues AS delta_total, c.critical - p.critical AS delta_critical, c.major - p.major AS delta_major
  FROM R c JOIN R p ON p.project = c.project AND c.age = 1 AND p.age = 2)
SELECT P.*,
  (SELECT count(*) FROM LOG l WHERE l.project = P.project AND l.scan_id = current_scan AND fingerprint NOT IN
    (SELECT fingerprint FROM LOG m WHERE m.project = P.project AND m.scan_id = previous_scan)) AS new_issues,
  (SELECT count(*) FROM LOG l WHERE l.project = P.project AND l.scan_id = previous_scan AND fingerprint NOT IN
    (SELECT fingerprint FROM LOG m WHERE m.project = P.project AND m.scan_id = current_scan)) AS fixed_issues
FROM P"""
LIFECYCLE = f"""WITH {LOG},
I AS (SELECT DISTINCT project, scan_id, fingerprint FROM LOG),
NOW AS (SELECT I.*, prev_id FROM I JOIN PREV USING (project, scan_id)),
NXT AS (SELECT project, prev_id AS scan_id, scan_id AS next_id FROM PREV WHERE prev_id IS NOT NULL)
SELECT n.project, n.scan_id, n.fingerprint,
  CASE WHEN p.fingerprint IS NULL THEN 'new' ELSE 'recurring' END AS status
FROM NOW n LEFT JOIN I p ON p.project = n.project AND p.scan_id = n.prev_id AND p.fingerprint = n.fingerprint
UNION ALL
SELECT i.project, x.next_id, i.fingerprint, 'fixed'
FROM I i JOIN NXT x USING (project, scan_id)
WHERE NOT EXISTS (SELECT 1 FROM I k WHERE k.project = i.project AND k.scan_id = x.next_id AND k.fingerprint = i.fingerprint)"""
CARRY_FORWARD = f"""WITH {LOG}
SELECT project || '@' || scan_id AS project, rule_id, file, line, severity FROM LOG
UNION ALL SELECT project || '@' || (scan_id + 1), rule_id, file, line, severity FROM LOG WHERE file LIKE '%.py'"""
DISMISSAL_EVENTS = """
DE AS (
  SELECT 'src' || user_id % 5 AS project, event_id AS seq, ts, 'rule' || event_id % 4 AS rule_id,
    CASE WHEN event_id % 12 = 0 THEN '' ELSE 'F' || user_id % 13 || '.' END AS file_pattern, 'reason ' || user_id AS reason
  FROM events WHERE event_type = 'view')
"""
_STATE_COLS = """project, rule_id, file_pattern, arg_min(reason, seq) AS reason, count(*) AS count, max(ts) AS last_ts,
  count(*) >= 3 AS auto_suppress"""
DISMISSALS = f"WITH {DISMISSAL_EVENTS} SELECT {_STATE_COLS} FROM DE GROUP BY project, rule_id, file_pattern"
DISMISSALS_PLACED = f"""SELECT *, row_number() OVER (PARTITION BY project ORDER BY "count" DESC, rule_id, file_pattern) AS place FROM ({DISMISSALS})"""
DISMISSALS_CLEARED = f"""WITH {DISMISSAL_EVENTS},
CL AS (SELECT 'src' || user_id % 5 AS project, event_id AS seq, 'rule' || event_id % 4 AS rule_id,
  CASE WHEN event_id % 997 = 0 THEN '' ELSE 'F' || user_id % 13 || '.' END AS pattern
  FROM events WHERE event_id % 101 = 0 OR event_id % 997 = 0)
SELECT {_STATE_COLS} FROM DE d
WHERE NOT EXISTS (SELECT 1 FROM CL c WHERE c.project = d.project AND c.rule_id = d.rule_id AND c.seq >= d.seq AND (c.pattern = '' OR c.pattern = d.file_pattern))
GROUP BY project, rule_id, file_pattern"""
UNSUPPRESSED = f"""WITH {LOG}, {DISMISSAL_EVENTS},
ST AS (SELECT {_STATE_COLS} FROM DE GROUP BY project, rule_id, file_pattern)
SELECT seq, project, rule_id, file, line FROM LOG l
WHERE NOT EXISTS (SELECT 1 FROM ST s WHERE s.auto_suppress AND s.project = l.project AND s.rule_id = l.rule_id
  AND (s.file_pattern = '' OR lower(coalesce(l.file, '')) LIKE '%' || lower(s.file_pattern) || '%'))"""

# ---- project index
_NL = "chr(10)"
_imports_py = f"list_transform(regexp_extract_all(content, {q('(?m)' + PY_IMPORT)}), lambda m: coalesce(nullif(regexp_extract(m, {q(PY_IMPORT)}, 1), ''), regexp_extract(m, {q(PY_IMPORT)}, 2)))"
_imports_js = f"list_transform(regexp_extract_all(content, {q(JS_IMPORT)}), lambda m: coalesce(nullif(regexp_extract(m, {q(JS_IMPORT)}, 1), ''), regexp_extract(m, {q(JS_IMPORT)}, 2)))"
_fns_js = f"list_transform(regexp_extract_all(content, {q(JS_FUNCTION)}), lambda m: coalesce(nullif(regexp_extract(m, {q(JS_FUNCTION)}, 1), ''), regexp_extract(m, {q(JS_FUNCTION)}, 2)))"
_skip_py = " OR ".join(f"starts_with({STRIP}, {q(p)})" for p in PY_STATE_SKIP)
_skip_js = " OR ".join(f"starts_with({STRIP}, {q(p)})" for p in JS_STATE_SKIP)
STATE_TEST = f"""((language = 'python' AND NOT starts_with(line, ' ') AND NOT starts_with(line, chr(9)) AND NOT ({_skip_py})
    AND regexp_matches({STRIP}, {q(PY_STATE)}))
  OR (language IN ('javascript', 'typescript') AND NOT ({_skip_js}) AND regexp_matches({STRIP}, {q(JS_STATE)})))"""
INDEX_CTE = f"""
SL AS (SELECT project, path, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS state_lines FROM L0 WHERE {STATE_TEST} GROUP BY ALL),
IX AS (
  SELECT F.project, F.path, language, strlen(content) AS size_bytes, CAST(n AS BIGINT) AS line_count, content,
    CASE WHEN ext = '.py' THEN {_imports_py} ELSE {_imports_js} END AS imports,
    CASE WHEN ext = '.py' THEN regexp_extract_all(content, {q('(?m)' + PY_FUNCTION)}, 1) ELSE {_fns_js} END AS functions,
    CASE WHEN ext = '.py' THEN regexp_extract_all(content, {q('(?m)' + PY_CLASS)}, 1) ELSE regexp_extract_all(content, {q(JS_CLASS)}, 1) END AS classes,
    coalesce(state_lines, '') AS state_lines
  FROM F LEFT JOIN SL USING (project, path)
  WHERE ext <> '.html' AND (F.project, F.path) NOT IN (SELECT (project, path) FROM SMALL))
"""
FILE_INDEX = f"""WITH {ALL_LINES}, {INDEX_CTE}
SELECT project, path, language, size_bytes, line_count, array_to_string(imports, ',') AS imports,
  array_to_string(functions, ',') AS functions, array_to_string(classes, ',') AS classes, state_lines AS global_state_lines,
  state_lines <> '' AS has_global_state FROM IX"""
PROJECT_TOTALS = f"""WITH {ALL_LINES}, {INDEX_CTE}
SELECT project, count(*) AS total_files, sum(line_count)::BIGINT AS total_lines,
  string_agg(DISTINCT language, ',' ORDER BY language) AS languages, count(*) FILTER (state_lines <> '') AS state_files
FROM IX GROUP BY project"""
# files that import one another: directory d<k % 7>, see fixtures.linked_files
LINK_CTE = """
D AS (SELECT doc_id, source AS project FROM documents),
FL AS (
  SELECT project, doc_id, 'lib/d' || doc_id % 7 || '/m' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' ELSE '.tsx' END AS path,
    doc_id % 7 AS dir FROM D
  UNION ALL SELECT DISTINCT project, NULL::BIGINT, 'lib/d' || k || '/shared/index.ts', k FROM D, range(7) r(k)
  UNION ALL SELECT DISTINCT project, NULL::BIGINT, 'lib/base.js', NULL FROM D),
ED AS (
  SELECT project, path AS src_path, 'lib/d' || dir || '/shared/index.ts' AS dst_path FROM FL WHERE doc_id IS NOT NULL
  UNION ALL SELECT project, path, 'lib/base.js' FROM FL WHERE doc_id IS NOT NULL
  UNION ALL SELECT a.project, a.path, b.path FROM FL a JOIN FL b ON b.project = a.project AND b.doc_id = a.doc_id - 140 WHERE a.doc_id % 2 = 0)
"""
IMPORT_EDGES = f"WITH {LINK_CTE} SELECT * FROM ED"
TOP_FILES = f"""WITH {LINK_CTE},
DG AS (SELECT project, dst_path AS path, count(*) AS in_degree FROM ED GROUP BY ALL),
W AS (SELECT FL.project, FL.path, coalesce(in_degree, 0) AS in_degree,
  coalesce(in_degree, 0) * 10 + CASE WHEN doc_id IS NULL THEN 1 ELSE 4 END AS score FROM FL LEFT JOIN DG USING (project, path)),
R AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, string_split(path, '/')) AS rank FROM W)
SELECT project, path, CAST(rank AS INT) AS rank, in_degree, CAST(score AS BIGINT) AS score FROM R WHERE rank <= 20"""
_py = lambda c: f"CASE WHEN {c} THEN 'True' ELSE 'False' END"
ARCHITECTURE = f"""WITH {ALL_LINES}, {INDEX_CTE}, {PROJECTS}, M AS ({_manifest_rows}), {CONTEXT_CTE},
T AS (SELECT project, count(*) AS nf, sum(line_count) AS nl, string_agg(DISTINCT language, ', ' ORDER BY language) AS langs FROM IX GROUP BY project),
S AS (SELECT project, string_agg(path, ', ' ORDER BY rk) AS st FROM
  (SELECT project, path, row_number() OVER (PARTITION BY project ORDER BY string_split(path, '/')) AS rk FROM IX WHERE state_lines <> '') WHERE rk <= 5 GROUP BY project)
SELECT project, concat_ws(chr(10), 'Project: ' || project,
  'Type: ' || CASE WHEN is_web_app THEN 'web app' WHEN is_cli THEN 'CLI' ELSE 'library' END,
  'Deployment: ' || coalesce(deployment, 'unknown'), 'Frameworks: ' || coalesce(nullif(replace(frameworks, ',', ', '), ''), 'none'),
  'Languages: ' || langs, 'Files: ' || nf || ', Lines: ' || nl, 'Serverless: ' || {_py('is_serverless')},
  'Files with global state: ' || st) AS summary
FROM T LEFT JOIN CX USING (project) LEFT JOIN S USING (project)"""
DIRECTORY_SUMMARY = f"""WITH {ALL_LINES},
K AS (SELECT project, path, chr(10) || '--- ' || path || ' ---' || chr(10) || content || chr(10) AS chunk FROM F WHERE ext <> '.html'),
R AS (SELECT *, sum(length(chunk)) OVER (PARTITION BY project ORDER BY string_split(path, '/') ROWS UNBOUNDED PRECEDING) AS running FROM K)
SELECT project, path, CAST(running AS BIGINT) AS running, md5(chunk) AS chunk FROM R WHERE running <= 50000"""
CONTEXT_PACK = f"""WITH {ALL_LINES}, {INDEX_CTE}, {PROJECTS}, M AS ({_manifest_rows}), {CONTEXT_CTE},
T AS (SELECT project, count(*) AS nf, sum(line_count) AS nl, string_agg(DISTINCT language, ', ' ORDER BY language) AS langs FROM IX GROUP BY project),
HEAD AS (SELECT project, ['PROJECT: ' || project, 'Files: ' || nf || ', Lines: ' || nl, 'Languages: ' || langs,
  'Deployment: ' || coalesce(deployment, 'unknown'), 'Frameworks: ' || coalesce(nullif(replace(frameworks, ',', ', '), ''), 'none detected'),
  'Serverless: ' || {_py('is_serverless')},
  'Web app: ' || {_py('is_web_app')} || ', API: ' || {_py('is_api')} || ', CLI: ' || {_py('is_cli')},
  'ORM: ' || {_py('has_orm')} || ', Template escaping: ' || {_py('has_template_escaping')}, ''] AS h
  FROM T LEFT JOIN CX USING (project)),
MARK AS (SELECT project, path, line_count, array_to_string(list_filter([
  CASE WHEN state_lines <> '' THEN 'GLOBAL_STATE' END,
  CASE WHEN len(classes) > 0 THEN 'classes:' || array_to_string(classes[1:3], ',') END,
  CASE WHEN len(functions) > 0 THEN 'fns:' || len(functions) END], lambda x: x IS NOT NULL), ', ') AS marks FROM IX),
FIXED AS (
  SELECT project, 0 AS section, '' AS name, array_to_string(h, chr(10)) AS text, list_sum(list_transform(h, lambda x: length(x))) AS chars FROM HEAD
  UNION ALL SELECT project, 1, path, t, length(t) FROM (SELECT project, path, '--- CONFIG: ' || path || ' ---' || chr(10) || left(content, 2000) || chr(10) AS t
    FROM M WHERE path NOT LIKE 'README%' AND path <> 'index.html')
  UNION ALL SELECT project, 2, path, t, length(t) FROM (SELECT project, path,
    '  ' || path || ' (' || line_count || 'L)' || CASE WHEN marks <> '' THEN ' [' || marks || ']' ELSE '' END AS t FROM MARK)),
USED AS (SELECT project, sum(chars) + 17 AS used FROM FIXED GROUP BY project),
TOPF AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY line_count DESC, string_split(path, '/')) AS rk FROM IX),
BODY AS (SELECT project, path, rk, '--- ' || path || ' ---' || chr(10) || content || chr(10) AS t FROM TOPF WHERE rk <= 30),
RUN AS (SELECT *, used + sum(length(t)) OVER (PARTITION BY project ORDER BY rk ROWS UNBOUNDED PRECEDING) AS running FROM BODY JOIN USED USING (project))
SELECT project, section, name, 0 AS pos, md5(text) AS text FROM FIXED
UNION ALL SELECT project, 3, path, CAST(rk AS INT), md5(t) FROM RUN WHERE running <= 100000"""

# ---- deep checks, each on whole lines
_script = "language IN ('javascript', 'typescript')"

_DL = "(SELECT * FROM L0 WHERE ext <> '.html' AND (project, path) NOT IN (SELECT (project, path) FROM SMALL))"
_kind = "CASE " + " ".join(f"WHEN {rx('line', p)} THEN {q(n)}" for p, n in deep.STATE_KINDS) + " ELSE 'mutable state' END"
_tv = f"try_cast(nullif(regexp_extract(line, {q('(?i)' + deep.TIMEOUT)}, 1), '') AS BIGINT)"
_sec = f"(CASE WHEN {_tv} > 1000 THEN {_tv} // 1000 ELSE {_tv} END)"
_limit = "(CASE deployment WHEN 'netlify' THEN 26 WHEN 'aws-lambda' THEN 900 ELSE 30 END)"
_named = f"nullif(regexp_extract(line, {q(deep.ADD_NAMED)}, 1), '')"
_event = f"coalesce({_named}, regexp_extract(line, {q(deep.ADD_ANY)}, 1))"
_dirs = lambda dirs: "(" + " OR ".join(f"contains(path, {q(d)})" for d in dirs) + ")"
_http = rx("line", deep.HTTP_CALL)
DEEP_RULES = {
    "serverless-stateful-code": ("critical", f"'Stateful ' || {_kind} || ' in serverless function'",
        f"DL JOIN CX USING (project) WHERE is_serverless AND {_dirs(deep.SERVER_DIRS)} AND {STATE_TEST}"),
    "timeout-exceeds-platform": ("major", f"'Timeout (' || {_sec} || 's) exceeds ' || deployment || ' limit (' || {_limit} || 's)'",
        f"DL JOIN CX USING (project) WHERE is_serverless AND {_sec} > {_limit}"),
    "recursive-serverless-invocation": ("critical", "'Possible recursive serverless invocation'",
        f"DL JOIN CX USING (project) WHERE is_serverless AND {_dirs(deep.ROUTE_DIRS)} AND {rx('line', deep.SELF_CALL)}"),
    "event-listener-leak": ("major", f"'Event listener ''' || {_event} || ''' never removed'",
        f"DL WHERE {_script} AND {rx('line', deep.ADD_ANY)} AND ({_named} IS NULL OR NOT EXISTS (SELECT 1 FROM DL r WHERE r.project = DL.project "
        f"AND r.path = DL.path AND regexp_extract(r.line, {q(deep.REMOVE)}, 1) = {_named.replace('line', 'DL.line')}))"),
    "blob-url-leak": ("major", "'Blob URL created but never revoked'",
        f"DL WHERE {_script} AND contains(line, 'createObjectURL') AND NOT EXISTS (SELECT 1 FROM DL r WHERE r.project = DL.project AND r.path = DL.path AND contains(r.line, 'revokeObjectURL'))"),
    "useeffect-missing-cleanup": ("major", "'useEffect adds listener without cleanup'",
        f"(SELECT *, string_agg(line, chr(10)) {frame(-1, 30)} AS ahead FROM DL) WHERE {_script} AND contains(line, 'useEffect') "
        "AND contains(ahead, 'addEventListener') AND NOT contains(string_split(ahead, '}, [')[1], 'return')"),
    "unguarded-async-handler": ("major", "'Async operation without re-entry guard'",
        f"(SELECT *, bool_or({rx('line', GUARD)}) {frame(9, 20)} AS guarded FROM DL) WHERE {_script} AND {rx('line', deep.ASYNC_EVENT)} AND NOT guarded"),
    "missing-api-timeout": ("major", "'External API call without timeout'",
        f"(SELECT *, bool_or(contains(lower(line), 'timeout')) {frame(2, 5)} AS near FROM DL) WHERE {_http} AND NOT {rx('line', deep.CURSOR_FETCH)} "
        f"AND NOT {rx('line', deep.NOT_CODE)} AND NOT near"),
    "missing-filesize-validation": ("major", "'File upload without size validation'",
        f"(SELECT project, path, min(line_no) FILTER ({rx('line', deep.FILE_INPUT)}) AS line_no FROM DL WHERE {_script} GROUP BY project, path "
        f"HAVING line_no IS NOT NULL AND NOT bool_or({rx('line', deep.SIZE_CHECK)})) JOIN CX USING (project) WHERE is_web_app"),
    "cors-wildcard-api": ("critical", "'CORS wildcard allows any website to use your API'",
        "(SELECT project, arg_min(path, (prio, string_split(path, '/'), line_no)) AS path, arg_min(line_no, (prio, string_split(path, '/'), line_no)) AS line_no FROM ("
        "SELECT project, path, length(split_part(content, '\"*\"', 1)) - length(replace(split_part(content, '\"*\"', 1), chr(10), '')) + 1 AS line_no, 0 AS prio "
        "FROM M WHERE path = 'vercel.json' AND contains(content, '\"*\"') AND contains(lower(content), 'access-control') "
        f"UNION ALL SELECT project, path, line_no, 1 FROM DL WHERE {rx('line', deep.CORS_ANY)}) GROUP BY project) JOIN CX USING (project) WHERE is_api"),
}
_DEEP_CTE = f"{LINES} DL AS {_DL}, {PROJECTS}, M AS ({_manifest_rows}), {CONTEXT_CTE}"
_deep_part = lambda r: (
    f"SELECT project, path AS file, CAST(line_no AS INT) AS line_no, {q(r)} AS rule_id, {q(DEEP_RULES[r][0])} AS severity, {DEEP_RULES[r][1]} AS title FROM {DEEP_RULES[r][2]}"
)
ASSETS = """
A AS (
  SELECT 'src' || p_partkey % 20 AS project, CASE p_partkey % 5 WHEN 0 THEN 'public' WHEN 1 THEN 'static' WHEN 2 THEN 'assets' WHEN 3 THEN 'dist' ELSE 'misc' END
    || '/a' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.wasm' WHEN 1 THEN '.js' WHEN 2 THEN '.png' ELSE '.css' END AS path,
    CAST(p_size AS BIGINT) * 262144 AS size_bytes FROM part)
"""
_uncached = (
    "SELECT project, path AS file, CAST(NULL AS INT) AS line_no, 'missing-cache-headers' AS rule_id, 'major' AS severity, "
    "'Large asset without cache headers (' || printf('%.1f', size_bytes / 1048576) || 'MB)' AS title FROM A "
    "WHERE regexp_matches(path, '^(public|static|assets|dist)/.*(wasm|js|css)$') AND size_bytes >= 1048576 "
    f"AND project NOT IN (SELECT project FROM M WHERE path = 'vercel.json' AND contains(lower(content), 'cache-control'))"
)


def deep_rule(rule_id: str) -> str:
    if rule_id == "missing-cache-headers":
        return f"WITH {MANIFEST}, {ASSETS} {_uncached}"
    return f"WITH {_DEEP_CTE} {_deep_part(rule_id)}"


DEEP_FINDINGS = (
    f"WITH {_DEEP_CTE}, {ASSETS} " + "\nUNION ALL ".join(_deep_part(r) for r in DEEP_RULES) + f"\nUNION ALL {_uncached}"
)
_domain = _pack_rules(["api", "browser", "react", "serverless"]).replace("FROM L ", "FROM DL ")
DEEP_SCAN = (
    f"WITH {_DEEP_CTE}, {ASSETS}, DP AS ({_domain}) SELECT project, file, line_no, rule_id, severity, title FROM DP UNION ALL "
    + "\nUNION ALL ".join(_deep_part(r) for r in DEEP_RULES) + f"\nUNION ALL {_uncached}"
)

# ---- personas
STYLE_CTE = f"""
SV AS (SELECT * FROM (VALUES {', '.join(f'({i}, {q(s)})' for i, s in enumerate(STYLES))}) v(k, style)),
ST AS (SELECT source AS project, 'styles/s' || doc_id || '.css' AS path, '.css' AS ext, doc_id,
  '/* ' || text || ' */' || chr(10) || style AS content FROM documents JOIN SV ON k = doc_id % 4)
"""
_PF = f"""{LINES} {PROJECTS}, M AS ({_manifest_rows}), {STYLE_CTE},
PF AS (
  SELECT project, path, ext, content FROM F UNION ALL SELECT project, path, ext, content FROM ST
  UNION ALL SELECT project, path, '.html', content FROM M WHERE path = 'index.html')"""
_sig = ",\n  ".join(
    f"bool_or({has('lower(content)', words)}) AS {name}" for name, words in persona.SIGNAL_WORDS.items()
)
SIGNALS_CTE = f"""
SG AS (
  SELECT project, bool_or({has('lower(path)', ['admin', 'dashboard'])}) AS has_admin,
  bool_or(contains(lower(content), 'dashboard') OR contains(lower(path), 'dashboard')) AS has_dashboard,
  bool_or(contains(lower(content), 'viewport') AND contains(lower(content), 'width=device-width')) AS has_mobile_meta,
  {_sig}
  FROM PF GROUP BY project)
"""
APP_TYPE = """CASE WHEN has_api_docs AND NOT has_forms THEN 'developer-tool'
  WHEN has_admin AND has_roles AND has_dashboard THEN 'b2b'
  WHEN has_payments OR has_file_upload OR has_video_audio THEN 'consumer'
  WHEN has_dashboard AND has_data_tables THEN 'b2b' ELSE 'consumer' END"""
PERSONA_SIGNALS = f"""WITH {_PF}, {SIGNALS_CTE},
RD AS (SELECT project, arg_min(content, CASE path WHEN 'README.md' THEN 0 ELSE 1 END) AS readme FROM M WHERE path LIKE 'README%' GROUP BY project)
SELECT SG.*, coalesce(readme, '') AS readme_content, {APP_TYPE} AS app_type FROM SG LEFT JOIN RD USING (project)"""
# signals as numbers of a project's documents, so that every kind of persona occurs
_feature_cols = {
    "has_video_audio": "k % 5 = 0", "has_file_upload": "k % 7 = 0", "has_dashboard": "k % 2 = 0",
    "has_data_tables": "k % 3 = 0", "has_api_docs": "k % 4 = 1", "has_admin": "k % 6 = 2", "has_roles": "k % 9 = 4",
    "has_mobile_meta": "k % 8 = 3", "has_responsive_css": "k % 10 = 7", "has_forms": "k % 11 = 1",
    "has_payments": "k % 13 = 5", "has_export": "k % 3 = 1",
}
FEATURES_CTE = "FT AS (SELECT 'u' || c_custkey AS project, c_custkey AS k, " + ", ".join(
    f"(c_custkey {e[2:]}) AS {n}" for n, e in _feature_cols.items()
) + " FROM customer)"
_people = " UNION ALL ".join(
    f"SELECT project, {pos} AS slot, {q(name)} AS name, {q(role)} AS role, {q(level)} AS tech_level, {q('|'.join(devices))} AS devices, "
    f"{q(persona.STORIES[key][0])} AS description, {q('|'.join(persona.FLOWS[key]))} AS key_flows, "
    f"{q('|'.join(persona.STORIES[key][1]))} AS goals, {q('|'.join(persona.STORIES[key][2]))} AS pain_points FROM FT WHERE {cond}"
    for key, pos, cond in [
        ("creator", 0, "has_video_audio OR has_file_upload"),
        ("business", 0, "NOT (has_video_audio OR has_file_upload) AND has_dashboard AND has_data_tables"),
        ("developer", 0, "NOT (has_video_audio OR has_file_upload) AND NOT (has_dashboard AND has_data_tables) AND has_api_docs"),
        ("user", 0, "NOT (has_video_audio OR has_file_upload) AND NOT (has_dashboard AND has_data_tables) AND NOT has_api_docs"),
        ("admin", 1, "has_admin OR has_roles"), ("visitor", 2, "true"), ("mobile", 3, "has_mobile_meta OR has_responsive_css"),
    ]
    for name, role, level, devices in [persona.PERSONAS[key]]
)
PEOPLE_CTE = f"""{FEATURES_CTE}, PP0 AS ({_people}),
PP AS (SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY slot) - 1 AS INT) AS pos,
  name, role, tech_level, devices, description, key_flows, goals, pain_points FROM PP0)"""
PERSONAS = f"WITH {PEOPLE_CTE} SELECT PP.*, {APP_TYPE} AS app_type FROM PP JOIN FT USING (project)"
PERSONAS_FILTERED = f"""WITH {PEOPLE_CTE},
MT AS (SELECT *, contains(lower(name), 'admin') AS hit, bool_or(contains(lower(name), 'admin')) OVER (PARTITION BY project) AS any_hit FROM PP)
SELECT project, name FROM MT WHERE hit OR NOT any_hit"""
_found = " UNION ALL ".join(
    f"SELECT project, {q(kind)} AS kind, unnest(regexp_extract_all(content, {q(pattern)}, 1)[1:20]) AS value FROM PF{where}"
    for kind, pattern, where in [
        ("page_routes", persona.ROUTES, ""), ("error_messages", persona.MESSAGES, ""),
        ("ui_text_samples", persona.UI_TEXT, " WHERE ext IN ('.tsx', '.html')"),
    ]
)
_sample_files = """
PF AS (SELECT source AS project, '.tsx' AS ext, 'route: "/r' || doc_id % 45 || '"' || chr(10) || 'message = "' || replace(text, chr(10), ' ')
  || '"' || chr(10) || '<b>' || upper(lang) || ' text ' || doc_id % 33 || '</b>' AS content FROM documents)"""
SAMPLES = f"""WITH {_sample_files}, V AS (SELECT DISTINCT * FROM ({_found})),
R AS (SELECT *, row_number() OVER (PARTITION BY project, kind ORDER BY value) AS rank FROM V)
SELECT project, kind, value, CAST(rank AS INT) AS rank FROM R WHERE rank <= CASE kind WHEN 'page_routes' THEN 30 ELSE 20 END"""

_near = "substr(content, greatest(strpos(content, line) - 1 - 200, 0) + 1, strpos(content, line) - 1 + 200 - greatest(strpos(content, line) - 1 - 200, 0))"
_touch = " OR ".join(f"contains({_near}, {q(t)})" for t in persona.TOUCH)
_unf = "CASE " + " ".join(f"WHEN {rx('line', p)} THEN {q(t)}" for p, t in persona.UNFRIENDLY) + " END"
_who = lambda cond: f"JOIN PP USING (project) WHERE {cond}"
_nontech, _mobile = "tech_level = 'non-technical'", "contains(devices, 'mobile')"
_null = "CAST(NULL AS VARCHAR)"
PERSONA_RULES = {
    "ui-jargon": ("major", f"'Technical jargon in UI: ''' || regexp_extract(line, {q(persona.JARGON)}, 1) || ''''", "line_no", "name",
        f"L0 {_who(_nontech)} AND ext IN ('.tsx', '.html') AND {rx('line', persona.JARGON)}"),
    "raw-error-code": ("major", "'Raw error code shown to user'", "line_no", "name",
        f"L0 {_who(_nontech)} AND ext IN ('.tsx', '.html') AND {rx('line', persona.ERROR_CODE, True)}"),
    "hover-only-interaction": ("minor", "'Hover-only interaction (no touch equivalent)'", "line_no", "name",
        "(SELECT project, path, min(line_no) AS line_no FROM (SELECT *, unnest(string_split(content, chr(10))) AS line, "
        "generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM ST) WHERE contains(line, ':hover') AND NOT contains(line, '@media') "
        f"AND NOT ({_touch}) GROUP BY project, path) {_who(_mobile)}"),
    "unfriendly-error": ("minor", _unf, "line_no", _null,
        f"L0 WHERE ext <> '.html' AND NOT {rx('line', persona.COMMENTED)} AND {_unf} IS NOT NULL"),
    "missing-loading-state": ("major", "'Data fetching without loading indicator'", "NULL", _null,
        f"F WHERE ext = '.tsx' AND {rx('content', persona.FETCHES)} AND NOT {rx('content', persona.LOADING, True)}"),
    "missing-empty-state": ("minor", "'List rendering without empty state'", "NULL", _null,
        f"F WHERE ext = '.tsx' AND {rx('content', persona.RENDERS)} AND NOT {rx('content', persona.EMPTY, True)}"),
    "missing-viewport": ("major", "'No viewport meta tag for mobile'", "NULL", "name",
        "(SELECT project, CAST(NULL AS VARCHAR) AS path FROM PF GROUP BY project HAVING bool_or(ext = '.html') "
        f"AND NOT bool_or(ext = '.html' AND contains(content, 'viewport') AND contains(content, 'width=device-width'))) {_who(_mobile)}"),
    "missing-api-docs": ("major", "'API routes exist but no API documentation'", "NULL", "name",
        "(SELECT project, CAST(NULL AS VARCHAR) AS path FROM PF GROUP BY project HAVING bool_or(contains(path, 'api/') AND ext IN ('.py', '.js'))) "
        + _who("tech_level = 'developer'")),
    "missing-export": ("minor", "'No data export functionality'", "NULL", "name",
        "(SELECT project, CAST(NULL AS VARCHAR) AS path FROM (SELECT DISTINCT project FROM PF) JOIN FT USING (project) WHERE NOT has_export) "
        + _who("name = 'Administrator'")),
    "large-asset-mobile": ("major", "'Large asset (' || printf('%.0f', size_bytes / 1048576) || 'MB) hurts mobile loading'", "NULL", "name",
        f"A {_who(_mobile)} AND regexp_matches(path, '^(public|static|assets)/') AND size_bytes > 5242880"),
}
# the personas of a project follow from its number, as in FEATURES_CTE
_FT_PROJECT = FEATURES_CTE.replace("'u' || c_custkey AS project, c_custkey AS k", f"project, {_number} AS k").replace(
    "c_custkey", _number
).replace("FROM customer", "FROM PRJ")
_PERSONA_CTE = f"{_PF}, {_FT_PROJECT}, PP0 AS ({_people}), PP AS (SELECT * FROM PP0), {ASSETS}"
_persona_part = lambda r: (
    f"SELECT project, path AS file, CAST({PERSONA_RULES[r][2]} AS INT) AS line_no, {q(r)} AS rule_id, {q(PERSONA_RULES[r][0])} AS severity, "
    f"{PERSONA_RULES[r][1]} AS title, {PERSONA_RULES[r][3]} AS persona FROM {PERSONA_RULES[r][4]}"
)
PERSONA_SCAN = f"WITH {_PF}, {SIGNALS_CTE}, FT AS (SELECT * FROM SG), PP0 AS ({_people}), PP AS (SELECT * FROM PP0), {ASSETS} " + "\nUNION ALL ".join(
    _persona_part(r) for r in PERSONA_RULES
)
PERSONA_FINDINGS = f"WITH {_PERSONA_CTE} " + "\nUNION ALL ".join(_persona_part(r) for r in PERSONA_RULES)


def persona_rule(rule_id: str) -> str:
    return f"WITH {_PERSONA_CTE} {_persona_part(rule_id)}"


# ---- intent
INTENT_CTE = """
AA AS (
  SELECT l_orderkey AS intent_id, l_linenumber AS idx, 'src' || min(l_suppkey) % 20 AS project,
    CASE l_linenumber % 8 WHEN 0 THEN 'dependency' WHEN 1 THEN 'route' WHEN 2 THEN 'behavior' WHEN 3 THEN 'security'
      WHEN 4 THEN 'function' WHEN 5 THEN 'file' WHEN 6 THEN 'pattern' ELSE 'ui' END AS type,
    'part ' || min(l_partkey) AS description, 'supplier ' || min(l_suppkey) AS expect, max(l_quantity) / 50 AS importance
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
AS0 AS (
  SELECT AA.*, CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'N' THEN 'partial' WHEN 'R' THEN 'fail' ELSE 'odd' END AS status,
    l_discount * 10 AS score, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS evidence,
    CASE WHEN l_partkey % 3 = 0 THEN 'src/p' || l_partkey || '.py' END AS location
  FROM AA JOIN lineitem ON l_orderkey = intent_id AND l_linenumber = idx)
"""
_dec = lambda e: f"CAST(sum(CAST({e} AS DECIMAL(28, 9))) AS DOUBLE)"
FIDELITY = f"""WITH {INTENT_CTE},
S AS (SELECT intent_id, count(*) AS results, CASE WHEN sum(importance) <> 0 THEN {_dec('score * importance')} / {_dec('importance')} * 100 ELSE 0.0 END AS f FROM AS0 GROUP BY 1)
SELECT intent_id, results, f AS fidelity, CASE WHEN f < 40 THEN 2 WHEN f < 70 THEN 1 ELSE 0 END AS gate FROM S"""
INTENT_FINDINGS = f"""WITH {INTENT_CTE}
SELECT project, location AS file, 'intent-' || type AS rule_id, CASE WHEN importance > 0.7 THEN 'major' ELSE 'minor' END AS severity,
  'Intent not met: ' || description AS title, 'Expected: ' || expect || chr(10) || 'Status: ' || status || chr(10) || 'Evidence: ' || coalesce(evidence, 'None found') AS description,
  intent_id, CAST(idx AS BIGINT) AS seq FROM AS0 WHERE status IN ('fail', 'partial')"""
BEST_INTENT = """
WITH C AS (
  SELECT 'p' || o_custkey AS project, CASE o_orderkey % 4 WHEN 0 THEN 'git_commit' WHEN 1 THEN 'spec_file' WHEN 2 THEN 'cli' ELSE 'chat' END AS source,
    CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE 'order ' || o_orderkey END AS text FROM orders),
R AS (SELECT project, source, trim(text) AS text, CASE source WHEN 'cli' THEN 1 WHEN 'spec_file' THEN 2 WHEN 'git_commit' THEN 3 END AS rk FROM C),
B AS (SELECT project, min((rk, source, text)) FILTER (rk IS NOT NULL AND text <> '') AS b FROM R GROUP BY project)
SELECT project, coalesce(b[2], 'none') AS source, coalesce(b[3], '') AS text FROM B"""

# ---- reviews taken in as data (payloads are built from events, see fixtures)
_REVIEWS = """
E AS (SELECT event_id AS e, 'src' || user_id % 5 AS project, 'src/f' || user_id % 13 || '.js' AS path, event_type AS t, value FROM events),
I AS (
  SELECT *, CAST(unnest([0, 1, 2]) AS BIGINT) AS seq FROM E WHERE e % 5 <> 3),
R AS (
  SELECT *, CASE (e + seq) % 4 WHEN 0 THEN 'Critical' WHEN 1 THEN 'INFO' WHEN 2 THEN 'blocker' END AS severity,
    CASE (e + seq) % 3 WHEN 0 THEN 'security' WHEN 1 THEN 'import' ELSE 'other' END AS category,
    CASE WHEN seq <> 2 THEN t || ' ' || e END AS title, CASE WHEN (e + seq) % 6 <> 0 THEN (e + seq) % 40 END AS line,
    CASE (e + seq) % 7 WHEN 0 THEN '1.5' WHEN 1 THEN NULL WHEN 2 THEN 'high' ELSE '0.25' END AS confidence FROM I)
"""
_conf = "CASE WHEN confidence IS NULL THEN 0.7::DOUBLE ELSE 0.25::DOUBLE END"
_usable = "(confidence IS NULL OR confidence = '0.25')"
FILE_REVIEWS = f"""WITH {_REVIEWS}
SELECT project, CASE WHEN coalesce(line, 0) <> 0 THEN path END AS file, CAST(nullif(line, 0) AS INT) AS line_no,
  CASE severity WHEN 'Critical' THEN 'critical' WHEN 'INFO' THEN 'info' ELSE 'minor' END AS severity,
  CASE category WHEN 'security' THEN 'security' WHEN 'import' THEN 'import' ELSE 'logic' END AS category,
  coalesce(title, 'LLM-detected issue') AS title, {_conf} AS confidence, 'llm-review' AS rule_id, seq
FROM R WHERE {_usable}"""
PROJECT_REVIEWS = f"""WITH {_REVIEWS}
SELECT project, CASE WHEN seq <> 1 THEN path END AS file, CASE WHEN seq <> 1 THEN CAST(nullif(line, 0) AS INT) END AS line_no,
  CASE severity WHEN 'Critical' THEN 'critical' WHEN 'INFO' THEN 'info' ELSE 'major' END AS severity,
  CASE category WHEN 'security' THEN 'security' ELSE 'logic' END AS category,
  coalesce(title, 'Deep analysis finding') AS title, {_conf} AS confidence, 'holistic-review' AS rule_id, seq
FROM R WHERE {_usable}"""
ASSERTIONS = """
WITH E AS (SELECT event_id AS e, event_type AS t FROM events WHERE event_id % 5 <> 3),
I AS (SELECT *, CAST(unnest([0, 1, 2]) AS INT) AS idx FROM E)
SELECT e AS intent_id, idx, CASE (e + idx) % 4 WHEN 0 THEN 'route' WHEN 1 THEN 'ui' ELSE 'behavior' END AS type,
  t || ' ' || idx AS description, 'expect ' || e AS expect, CASE (e + idx) % 3 WHEN 0 THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS importance
FROM I WHERE (e + idx) % 3 <> 2"""
STEP_EVALUATIONS = """
SELECT event_id, CASE WHEN event_id % 5 = 3 THEN 'confused' ELSE event_type END AS feeling,
  CASE WHEN event_id % 5 = 3 THEN 'scroll' ELSE 'click' END AS action,
  CASE WHEN event_id % 5 = 3 THEN 'Evaluation failed' ELSE 'saw ' || event_id END AS observation,
  CASE WHEN event_id % 5 <> 3 AND event_id % 2 = 0 THEN 'slow' END AS friction,
  CASE WHEN event_id % 5 = 3 THEN '' END AS target
FROM events"""

# ---- journeys
STEPS = """
SP AS (
  SELECT user_id || '-' || extract(day FROM ts) AS journey_id, user_id, ts, event_id,
    CAST(row_number() OVER (PARTITION BY user_id, extract(day FROM ts) ORDER BY ts, event_id) AS INT) AS step_num,
    CASE event_type WHEN 'signup' THEN 'smooth' WHEN 'purchase' THEN 'smooth' WHEN 'view' THEN 'confused' WHEN 'click' THEN 'frustrated' ELSE 'lost' END AS feeling,
    CASE WHEN value > 20 THEN 'slow step ' || event_type WHEN value > 15 THEN '' END AS friction,
    CASE WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'error' AND value > 10 THEN 'give_up' ELSE 'click' END AS action
  FROM events)
"""
_agg = """count(*) AS steps, count(*) FILTER (friction <> '') AS friction_count, count(*) FILTER (feeling = 'smooth') AS smooth_count,
  bool_or(action = 'done') AS task_completed, bool_or(action = 'give_up') AS gave_up,
  sum(CASE feeling WHEN 'smooth' THEN 100 WHEN 'confused' THEN 50 WHEN 'frustrated' THEN 20 ELSE 0 END) // count(*) AS mean"""
_score = """CAST(floor(CASE WHEN task_completed THEN 1::DOUBLE ELSE 0.7::DOUBLE END * CASE WHEN gave_up THEN least(mean, 30) ELSE mean END) AS INT) AS experience_score"""
JOURNEYS_CTE = f"{STEPS}, JA AS (SELECT journey_id, {_agg} FROM SP GROUP BY 1), JS AS (SELECT * EXCLUDE (mean), {_score} FROM JA)"
STEP_NUMBERS = f"WITH {STEPS} SELECT event_id, journey_id, step_num FROM SP"
JOURNEY_SCORES = f"WITH {JOURNEYS_CTE} SELECT * FROM JS"
WORST = f"""WITH {JOURNEYS_CTE}
SELECT split_part(journey_id, '-', 1) AS user_key, min(experience_score) AS worst,
  CASE WHEN min(experience_score) < 30 THEN 2 WHEN min(experience_score) < 60 THEN 1 ELSE 0 END AS gate FROM JS GROUP BY 1"""
STEP_HISTORY = f"""WITH {STEPS}
SELECT journey_id, step_num, coalesce(array_to_string(list(feeling || '/' || action) OVER (PARTITION BY journey_id ORDER BY step_num ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), ' '), '') AS history FROM SP"""
TOP_FRICTIONS = f"""WITH {STEPS}, R AS (SELECT *, row_number() OVER (PARTITION BY journey_id ORDER BY step_num) AS rank FROM SP WHERE friction <> '')
SELECT journey_id, CAST(rank AS INT) AS rank, step_num, friction FROM R WHERE rank <= 5"""

# ---- fixes
_FIXES = f"""
FX0 AS (
  SELECT project, file AS path, line_no, rule_id, title, severity FROM SEC WHERE rule_id IN ('dangerous-eval', 'ssl-disabled', 'sql-injection')),
FX AS (
  SELECT *, CASE rule_id WHEN 'dangerous-eval' THEN 'result = eval(payload)' WHEN 'ssl-disabled' THEN 'verify=False ' ELSE 'not in the file' END AS old_code,
    CASE rule_id WHEN 'dangerous-eval' THEN 'result = json.loads(payload)' ELSE 'verify=True' END AS new_code,
    CASE WHEN line_no % 2 = 0 THEN 0.95::DOUBLE ELSE 0.75::DOUBLE END AS given FROM FX0),
FC AS (
  SELECT FX.*, content, CASE WHEN contains(content, old_code) OR contains(regexp_replace(content, '[ \\t]+(\\n|$)', '\\1', 'g'), rtrim(old_code)) THEN given
    ELSE greatest(0, given - 0.3::DOUBLE) END AS confidence
  FROM FX JOIN F USING (project, path))
"""
FIX_WINDOWS = f"""WITH {ALL_LINES}, {security_cte()},
W AS (SELECT DISTINCT project, file AS path, line_no AS place FROM SEC)
SELECT W.project, W.path, place AS line_no, string_agg(L.line_no || ': ' || line, chr(10) ORDER BY L.line_no) AS context
FROM W JOIN L ON L.project = W.project AND L.path = W.path AND L.line_no BETWEEN place - 10 AND place + 10 GROUP BY ALL"""
USABLE_FIXES = f"""WITH {ALL_LINES}, {security_cte()}, {_FIXES}
SELECT project, path, line_no, rule_id, round(confidence, 6) AS confidence, severity, title FROM FC WHERE confidence >= 0.7"""
# every fix of the kept ones replaces the first 'eval' line that is left; a trailing blank makes
# the other fix match nothing
APPLIED_FIXES = f"""WITH {ALL_LINES}, {security_cte()}, {_FIXES},
K AS (SELECT project, path, count(*) FILTER (rule_id = 'dangerous-eval') AS evals, count(*) AS tried FROM FC WHERE confidence >= 0.7 GROUP BY ALL),
N AS (SELECT L.*, sum(CASE WHEN contains(line, 'result = eval(payload)') THEN 1 ELSE 0 END) OVER (PARTITION BY project, path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS nth FROM L)
SELECT project, path, md5(string_agg(CASE WHEN nth <= evals THEN replace(line, 'result = eval(payload)', 'result = json.loads(payload)') ELSE line END, chr(10) ORDER BY line_no)) AS content,
  CAST(least(any_value(evals), sum(CASE WHEN contains(line, 'result = eval(payload)') THEN 1 ELSE 0 END)) AS INT) AS applied, CAST(any_value(tried) AS INT) AS tried
FROM N JOIN K USING (project, path) GROUP BY project, path"""

# ---- reports
REPORT_JSON = f"""WITH {ALL_LINES}, {security_cte()}, {SUMMARY_CTE.format('SEC')}
SELECT project, 'summary' AS record, NULL AS rule_id, NULL AS file, NULL AS line, CAST(total_issues AS VARCHAR) AS total FROM SUMMARY
UNION ALL SELECT project, 'issue', rule_id, file, CAST(line_no AS VARCHAR), NULL FROM SEC"""
_why = "CASE rule_id " + " ".join(f"WHEN {q(k)} THEN {q(v[0])}" for k, v in security.ADVICE.items()) + " END"
_fix = "CASE rule_id " + " ".join(f"WHEN {q(k)} THEN {q(v[1])}" for k, v in security.ADVICE.items()) + " END"
REPORT_MARKDOWN = f"""WITH {ALL_LINES}, {security_cte()}, {SUMMARY_CTE.format('SEC')}
SELECT project, 0 AS section, 0 AS rank, '# Code Report' || chr(10) || '**Project:** ' || project || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10)
  || '| Severity | Count |' || chr(10) || '|----------|-------|' || chr(10) || '| Critical | ' || critical || ' |' || chr(10) || '| Major | ' || major || ' |' || chr(10)
  || '| Minor | ' || minor || ' |' || chr(10) || '| Info | ' || info || ' |' || chr(10) || '| **Total** | **' || total_issues || '** |' || chr(10) AS text FROM SUMMARY
UNION ALL SELECT project, 2, 0, '## Issues' || chr(10) FROM SUMMARY
UNION ALL SELECT project, 3, 0, '### [!!!] CRITICAL (' || critical || ')' || chr(10) FROM SUMMARY WHERE critical > 0
UNION ALL SELECT project, 3, 1, '### [!!] MAJOR (' || major || ')' || chr(10) FROM SUMMARY WHERE major > 0
UNION ALL SELECT project, 3, CASE severity WHEN 'critical' THEN 0 ELSE 1 END, '- **[SECURITY]** ' || title || ' `' || file || ':' || line_no || '`' || chr(10)
  || '  ' || {_why} || chr(10) || '  > Fix: ' || {_fix} || chr(10) FROM SEC"""

# ---- streams
STREAM_DISMISSALS = f"""WITH {DISMISSAL_EVENTS} SELECT project, rule_id, file_pattern, count(*) AS count, count(*) >= 3 AS auto_suppress FROM DE GROUP BY ALL"""
STREAM_RATE = """WITH W AS (
  SELECT 'src' || user_id % 5 AS project, date_trunc('hour', ts) AS window_start, count(*) AS total_issues,
    count(*) FILTER (event_type = 'error') AS critical, count(*) FILTER (event_type = 'purchase') AS major,
    count(*) FILTER (event_type = 'click') AS minor, count(*) FILTER (event_type NOT IN ('error', 'purchase', 'click')) AS info
  FROM events GROUP BY ALL)
SELECT * FROM W WHERE window_start + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)"""
STREAM_JOURNEYS = f"""WITH {STEPS},
G AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM SP),
N AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM G),
JA AS (SELECT user_id, k, min(ts) AS session_start, max(ts) AS last_ts, {_agg} FROM N GROUP BY user_id, k)
SELECT user_id, session_start, steps, friction_count, smooth_count, task_completed, gave_up, {_score} FROM JA
WHERE last_ts + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)"""
STREAM_GATES = f"""WITH {LOG}, {SUMMARY_CTE.format('LOG').replace('SELECT project,', 'SELECT project, scan_id,').replace('GROUP BY project', 'GROUP BY project, scan_id')}
SELECT * FROM SUMMARY WHERE gate > 0"""

# ---- further faces of the same operators
SCAN_CHANGE_SET = f"""WITH {_scan_cte()}
SELECT a.project, a.file, a.line_no, a.rule_id, a.severity FROM ADJ a JOIN F ON F.project = a.project AND F.path = a.file
WHERE NOT starts_with(a.file, 'app/') AND F.doc_id % 3 = 0 AND F.doc_id % 7 <> 1"""
PROJECT_LANGUAGES = f"""WITH {ALL_LINES}
SELECT project, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM F WHERE language IS NOT NULL GROUP BY project"""
EFFECT_PARITY = f"""WITH {_DEEP_CTE}
SELECT project, path AS file, line_no FROM (SELECT *, coalesce(string_agg(line, chr(10)) {frame(-1, 30)}, '') AS ahead FROM DL)
WHERE {_script} AND contains(line, 'useEffect') AND CASE WHEN contains(ahead, '}}, [')
  THEN contains(ahead, 'addEventListener') AND NOT contains(string_split(ahead, '}}, [')[1], 'return') ELSE ahead <> '' END"""
# rank of each finding in the order severity, project, path by component, line, rule
ORDERED = f"""WITH {ALL_LINES}, {security_cte()}
SELECT project, file, line_no, rule_id,
  row_number() OVER (PARTITION BY project ORDER BY CASE severity WHEN 'critical' THEN 0 ELSE 1 END, string_split(file, '/'), line_no, rule_id) AS place
FROM SEC"""
DEEP_ORDERED = f"""
SELECT project, file, line_no, rule_id, row_number() OVER (PARTITION BY project ORDER BY
  CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END, string_split(coalesce(file, ''), '/'),
  coalesce(line_no, 0), rule_id) AS place
FROM ({DEEP_FINDINGS})"""
_confidence = {d.rule.rule_id: d.rule.confidence for d in security.security_detectors()}
_sure = "CASE rule_id " + " ".join(f"WHEN {q(k)} THEN {q(repr(v))}" for k, v in _confidence.items()) + " END"
_SCORES = f"""
SC AS (
  SELECT project, 'keep ' || project AS raw_intent,
         round_even(CASE WHEN sum(importance) <> 0 THEN {_dec('score * importance')} / {_dec('importance')} * 100 ELSE 0.0 END, 1) AS score
  FROM AS0 GROUP BY project)"""
_j = lambda e: f"to_json({e})::VARCHAR"
REPORT_JSON_FULL = f"""WITH {ALL_LINES}, {security_cte()}, {SUMMARY_CTE.format('SEC')}, {INTENT_CTE}, {_SCORES}
SELECT project, 'summary' AS record,
  '{{"version":"1.0.0","timestamp":"2024-05-06T07:08:09Z","project":' || {_j('project')} || ',"target":' || {_j("'checkouts/' || project")}
  || coalesce(',"intent":' || {_j('raw_intent')}, '') || ',"summary":{{"total_issues":' || total_issues || ',"critical":' || critical
  || ',"major":' || major || ',"minor":' || minor || ',"info":' || info || coalesce(',"fidelity_score":' || {_j('score')}, '')
  || ',"engines_run":["code"],"scan_duration_ms":1234}}}}' AS body
FROM SUMMARY LEFT JOIN SC USING (project)
UNION ALL SELECT project, 'issue',
  '{{"id":' || {_j("'f-' || rule_id || '-' || file || ':' || line_no")} || ',"rule_id":' || {_j('rule_id')} || ',"severity":' || {_j('severity')}
  || ',"category":"security","title":' || {_j('title')} || ',"description":' || {_j(_why)} || ',"suggestion":' || {_j(_fix)} || ',"confidence":' || {_sure}
  || ',"engine":"code","evidence":' || {_j('evidence')} || ',"location":{{"file":' || {_j('file')} || ',"line":' || line_no || '}}}}'
FROM SEC
UNION ALL SELECT project, 'intent',
  '{{"idx":' || (intent_id * 100 + idx) || ',"description":' || {_j('description')} || ',"expect":' || {_j('expect')} || ',"status":' || {_j('status')}
  || coalesce(',"evidence":' || {_j('evidence')}, '') || '}}'
FROM AS0"""
REPORT_MARKDOWN_FULL = f"""WITH BASE AS ({REPORT_MARKDOWN}), {INTENT_CTE.strip()}, {_SCORES}
SELECT project, section, rank,
  CASE WHEN section = 3 AND starts_with(text, '### ') THEN -1 WHEN section = 3 THEN CAST(regexp_extract(text, ':(\\d+)`', 1) AS BIGINT) ELSE 0 END AS line_key,
  replace(text, '**Project:** ' || project || chr(10), '**Project:** ' || project || chr(10) || '**Target:** checkouts/' || project || chr(10)
    || '**Date:** 2024-05-06' || chr(10) || '**Duration:** 1234ms' || chr(10)) AS text
FROM BASE
UNION ALL SELECT project, 1, 0, 0, '**Prompt Fidelity Score:** ' || score || '/100' || chr(10) FROM SC
UNION ALL SELECT project, 4, 0, 0, '## Intent Verification' || chr(10) || chr(10) || '**Intent:** ' || raw_intent || chr(10) || '**Fidelity Score:** ' || score || '/100' || chr(10) FROM SC
UNION ALL SELECT project, 5, 0, intent_id * 100 + idx, '- [' || CASE status WHEN 'pass' THEN '+' WHEN 'fail' THEN 'x' WHEN 'partial' THEN '~' ELSE '?' END || '] '
  || description || chr(10) || '  Expected: ' || expect || chr(10) || coalesce('  Found: ' || nullif(evidence, '') || chr(10), '') FROM AS0"""
