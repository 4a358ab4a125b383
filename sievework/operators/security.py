"""Security rules on single lines."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sievework.functions.predicates import both, case, either, has, isin, match, text
from sievework.operators.lines import (
    COMMENT_LINE,
    DEFINITION_LINE,
    LITERAL_LINE,
    PYTHON,
    SCRIPT,
    Detector,
    line_findings,
)
from sievework.schema import Rule
from sievework.sources.literals import signs

# Patterns, severities and titles of the security rules.
# (rule id, extensions or None for all, severity, title, ignore case, regexes, hints)
SECURITY_RULES = [
    (
        "hardcoded-secret", None, "critical", "Hardcoded secret/API key", True,
        [r"""(?:api[_-]?key|api[_-]?secret|auth[_-]?token|access[_-]?token|secret[_-]?key|private[_-]?key)\s*[=:]\s*['"][A-Za-z0-9+/=_\-]{16,}['"]"""],
        [],
    ),
    (
        "hardcoded-password", None, "critical", "Hardcoded password", True,
        [r"""(?:password|passwd|pwd)\s*[=:]\s*['"][^'"]{4,}['"]"""],
        [],
    ),
    (
        "sql-injection", PYTHON, "critical", "SQL injection vulnerability", False,
        [
            r"""(?:execute|executemany)\s*\(\s*(?:f['"]|['"].*?%s|['"].*?\.format)""",
            r"""(?:execute|executemany)\s*\(\s*['"].*?['"]\s*\+\s*(?!['"\d])""",
        ],
        ["execute"],
    ),
    (
        "command-injection", PYTHON, "major", "Command injection risk (shell=True)", False,
        [r"""subprocess\.(?:call|run|Popen)\s*\([^)]*shell\s*=\s*True"""],
        ["subprocess."],
    ),
    (
        "dangerous-eval", PYTHON, "critical", "Dangerous eval() usage", False,
        [r"""eval\s*\("""],
        ["eval"],
    ),
    (
        "insecure-deserialization", PYTHON, "major", "Insecure deserialization (pickle)", False,
        [r"""pickle\.loads?\s*\("""],
        ["pickle.load"],
    ),
    (
        "unsafe-yaml", PYTHON, "major", "Unsafe YAML loading", False,
        [r"""yaml\.load\s*\([^)]*\)(?!.*Loader)"""],
        ["yaml.load"],
    ),
    (
        "ssl-disabled", PYTHON, "major", "SSL verification disabled", False,
        [r"""verify\s*=\s*False"""],
        ["verify"],
    ),
    (
        "xss-innerhtml", SCRIPT, "critical", "XSS vulnerability (innerHTML)", False,
        [r"""\.innerHTML\s*=\s*[a-zA-Z_$]"""],
        [".innerHTML"],
    ),
    (
        "xss-react-dangerous", SCRIPT, "major", "XSS risk (dangerouslySetInnerHTML)", False,
        [r"""dangerouslySetInnerHTML\s*=\s*\{"""],
        ["dangerouslySetInnerHTML"],
    ),
    (
        "dangerous-eval-js", SCRIPT, "critical", "Dangerous eval/Function usage", False,
        [r"""(?:eval|Function)\s*\("""],
        ["eval", "Function"],
    ),
    (
        "sql-injection-js", SCRIPT, "critical", "SQL injection vulnerability", False,
        [r"""(?:query|sql)\s*(?:=|:)\s*(?:`[^`]*\$\{|['"].*?\+)"""],
        ["query", "sql"],
    ),
    (
        "document-write", SCRIPT, "major", "document.write usage", False,
        [r"""document\.write\s*\("""],
        ["document.write"],
    ),
    (
        "localstorage-sensitive", SCRIPT, "major", "Sensitive data in localStorage", True,
        [r"""localStorage\.setItem\s*\(\s*['"](?:token|jwt|auth|session|password|secret)"""],
        [],
    ),
    (
        "cors-wildcard", SCRIPT, "major", "CORS allows all origins", False,
        [r"""(?:cors|CORS).*(?:origin|Origin)\s*[:=]\s*['"]\*['"]"""],
        ["cors", "CORS"],
    ),
]
SQL_CONCAT_TITLE = "SQL injection vulnerability (string concatenation)"
SAFE_SOURCES = [
    "os.getenv", "os.environ", "process.env", "getenv(", "environ[", "environ.get",
    "config(", "Config(",
]

# Advice, in our own words.
ADVICE = {
    "hardcoded-secret": ("A credential is written into the source.", "Read it from the environment or a secret store."),
    "hardcoded-password": ("A password is written into the source.", "Read it from the environment or a secret store."),
    "sql-injection": ("The statement text is assembled from values.", "Bind the values as parameters."),
    "command-injection": ("A shell interprets the command line.", "Pass an argument list and leave the shell off."),
    "dangerous-eval": ("Evaluates text as code.", "Parse literals or JSON instead."),
    "insecure-deserialization": ("Unpickling can run code chosen by whoever wrote the bytes.", "Use a data-only format such as JSON."),
    "unsafe-yaml": ("A full YAML load can construct arbitrary objects.", "Use the safe loader."),
    "ssl-disabled": ("Certificates are not checked.", "Keep verification on and supply the CA file."),
    "xss-innerhtml": ("Markup from a variable is parsed as HTML.", "Set text, or sanitize the markup first."),
    "xss-react-dangerous": ("Raw markup bypasses React's escaping.", "Sanitize the markup before rendering it."),
    "dangerous-eval-js": ("Evaluates text as code.", "Parse JSON instead."),
    "sql-injection-js": ("The statement text is assembled from values.", "Bind the values as parameters."),
    "document-write": ("Can replace the page and inject markup.", "Build and append DOM nodes."),
    "localstorage-sensitive": ("Any script on the page can read local storage.", "Keep session secrets in an HttpOnly cookie."),
    "cors-wildcard": ("Every origin may call this API.", "List the trusted origins."),
}


SKIPPED = either([has("line", "/*"), COMMENT_LINE, DEFINITION_LINE, LITERAL_LINE])
# case-insensitive rules first look for a quote, which all of them ask for, then for a word in the lower-cased line
QUOTES = ("'", '"')
LOWER_HINTS = {
    "hardcoded-secret": ["key", "secret", "token"],
    "hardcoded-password": ["password", "passwd", "pwd"],
    "localstorage-sensitive": ["localstorage.setitem"],
}


def security_detectors() -> list[Detector]:
    out = []
    for rule_id, exts, severity, title, ignore_case, regexes, hints in SECURITY_RULES:
        test = [either(match("line", rx, ignore_case, hints) for rx in regexes)]
        if rule_id in LOWER_HINTS:
            test = [has("line", *QUOTES), has("lower(line)", *LOWER_HINTS[rule_id]), *test]
        if exts is not None:
            test.insert(0, isin("ext", exts))
        test.append(f"NOT {SKIPPED}")
        if rule_id in ("hardcoded-secret", "hardcoded-password"):
            test.append(f"NOT {has('line', *SAFE_SOURCES)}")
        sql = rule_id in ("sql-injection", "sql-injection-js")
        why, remedy = ADVICE[rule_id]
        out.append(
            Detector(
                Rule(rule_id, severity, "security", 0.85, "code", title, why, remedy),
                both(*test),
                signs=signs(*regexes),
                needs=("in_block", "sql_safe") if sql else ("in_block",),
                keep="NOT in_block AND NOT sql_safe" if sql else "NOT in_block",
                # the first of the two patterns names the finding
                title=case((match("line", regexes[0]), text(title)), default=text(SQL_CONCAT_TITLE))
                if rule_id == "sql-injection"
                else None,
            )
        )
    return out


def security_findings(files: DataFrame) -> DataFrame:
    return line_findings(files, security_detectors())
