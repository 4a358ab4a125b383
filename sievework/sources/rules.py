"""Line rules as data: built-in packs, YAML/JSON rule files, checks on user rules."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from sievework.sources.literals import check_regex, filled, shape

try:
    import yaml
except ImportError:  # JSON rule files still load
    yaml = None

# Languages of rule files and their extensions, severity and category names,
# limits on user regexes.
LANGUAGE_EXTS = {
    "python": [".py"],
    "javascript": [".js", ".jsx"],
    "typescript": [".ts", ".tsx"],
    "go": [".go"],
    "rust": [".rs"],
    "java": [".java"],
    "ruby": [".rb"],
}
SEVERITY_NAMES = {
    "critical": "critical", "error": "critical", "major": "major", "warning": "major",
    "minor": "minor", "info": "info",
}
CATEGORY_NAMES = ("security", "performance", "logic", "style", "ai_pattern")
MAX_REGEX = 500
BACKTRACKING = ["(.*)*", "(.+)+", "(a+)+", "(a*)*"]

# Ids, patterns, severities, categories and messages of the built-in packs.
# "hints" (ours) are substrings every match contains one of; see functions.text.matches.
AI_PATTERNS = [
    {"id": "todo-fixme-left", "regex": r"(?:TODO|FIXME|HACK|XXX|TEMP)[\s:]+.*",
     "severity": "info", "category": "ai_pattern", "message": "TODO/FIXME left in code",
     "hints": ["TODO", "FIXME", "HACK", "XXX", "TEMP"]},
    {"id": "console-log-left", "regex": r"console\.log\s*\(", "regex-not": r"//.*console\.log",
     "languages": ["javascript", "typescript"], "severity": "minor", "category": "ai_pattern",
     "message": "console.log left in code", "hints": ["console.log"]},
    {"id": "commented-out-code",
     "regex": r"^\s*(?://|#)\s*(?:const|let|var|function|def|class|import|from|if|for|while|return)\s",
     "severity": "minor", "category": "ai_pattern", "message": "Commented-out code",
     "hints": ["//", "#"]},
]
PERFORMANCE = [
    {"id": "unbounded-query",
     "regex": r"\.find\(\s*\{\s*\}\s*\)|\.find\(\s*\)|SELECT\s+\*\s+FROM\s+\w+\s*;?\s*$",
     "languages": ["javascript", "typescript", "python"], "severity": "major",
     "category": "performance", "message": "Unbounded database query",
     "hints": [".find(", "SELECT"]},
    {"id": "no-index-hint", "regex": r"CREATE\s+TABLE.*\);\s*$",
     "languages": ["python", "javascript", "typescript"], "severity": "minor",
     "category": "performance", "message": "Table created without indexes", "hints": ["CREATE"]},
]
SECURITY = [
    {"id": "jwt-secret-hardcoded", "regex": r"""jwt\.sign\s*\([^)]*,\s*["'][^"']{8,}""",
     "languages": ["javascript", "typescript"], "severity": "critical", "category": "security",
     "message": "JWT signed with hardcoded secret", "hints": ["jwt.sign"]},
    {"id": "bcrypt-low-rounds", "regex": r"bcrypt\.\w+\([^)]*,\s*[1-7]\s*[,)]",
     "languages": ["javascript", "typescript", "python"], "severity": "major",
     "category": "security", "message": "bcrypt rounds too low (< 8)", "hints": ["bcrypt."]},
    {"id": "debug-mode-production", "regex": r"DEBUG\s*=\s*True", "languages": ["python"],
     "severity": "major", "category": "security", "message": "Debug mode enabled",
     "hints": ["DEBUG"]},
]
API = [
    {"id": "api-no-rate-limit",
     "regex": r"(?:app\.post|app\.get|router\.post|router\.get|export\s+(?:async\s+)?function\s+(?:GET|POST|PUT|DELETE))",
     "regex-not": r"rateLimit|rate_limit|throttle|Throttle|limiter|Limiter",
     "languages": ["javascript", "typescript", "python"], "severity": "major",
     "category": "security", "message": "API endpoint without rate limiting",
     "hints": ["app.", "router.", "export"]},
    {"id": "api-no-input-validation",
     "regex": r"(?:req\.body|req\.query|req\.params|request\.json|request\.form)",
     "regex-not": r"validate|Validate|schema|Schema|zod|yup|joi|pydantic|TypeAdapter",
     "languages": ["javascript", "typescript", "python"], "severity": "major",
     "category": "security", "message": "Request input used without validation",
     "hints": ["req.", "request."]},
    {"id": "api-error-leaks-stack",
     "regex": r"(?:res\.(?:json|send)\s*\(\s*(?:err|error)|return\s+(?:Response|JsonResponse)\s*\(.*(?:str\(e\)|error\.message|traceback))",
     "languages": ["javascript", "typescript", "python"], "severity": "major",
     "category": "security", "message": "Error response may leak stack trace",
     "hints": ["res.", "return"]},
    {"id": "api-no-auth-check",
     "regex": r"""(?:app\.(?:post|put|delete|patch)|router\.(?:post|put|delete|patch))\s*\(\s*['"][^'"]+""",
     "regex-not": r"auth|Auth|middleware|protect|guard|verify|token|session|passport|jwt",
     "languages": ["javascript", "typescript"], "severity": "major", "category": "security",
     "message": "Mutating endpoint without auth middleware", "hints": ["app.", "router."]},
]
BROWSER = [
    {"id": "browser-no-abort-controller", "regex": r"new\s+(?:XMLHttpRequest|fetch)\s*\(",
     "regex-not": r"AbortController|signal", "languages": ["javascript", "typescript"],
     "severity": "minor", "category": "logic", "message": "HTTP request without AbortController",
     "hints": ["XMLHttpRequest", "fetch"]},
    {"id": "browser-document-ready-check",
     "regex": r"document\.getElementById|document\.querySelector",
     "regex-not": r"DOMContentLoaded|addEventListener|useEffect|componentDidMount",
     "languages": ["javascript", "typescript"], "severity": "minor", "category": "logic",
     "message": "DOM query may run before DOM is ready", "hints": ["document."]},
    {"id": "browser-localstorage-no-try",
     "regex": r"localStorage\.(?:getItem|setItem|removeItem)", "regex-not": r"try|catch",
     "languages": ["javascript", "typescript"], "severity": "minor", "category": "logic",
     "message": "localStorage access without try/catch", "hints": ["localStorage."]},
]
REACT = [
    {"id": "react-setstate-in-render", "regex": r"(?:setState|set[A-Z]\w+)\s*\(",
     "regex-not": r"useEffect|useCallback|useMemo|onClick|onChange|onSubmit|handler|Handler",
     "languages": ["javascript", "typescript"], "severity": "major", "category": "performance",
     "message": "Possible setState during render", "files": ["*.tsx", "*.jsx"], "hints": ["set"]},
    {"id": "react-array-index-key",
     "regex": r"\.map\s*\([^)]*,\s*(?:index|i|idx)\s*\).*key\s*=\s*\{?\s*(?:index|i|idx)",
     "languages": ["javascript", "typescript"], "severity": "minor", "category": "performance",
     "message": "Array index used as React key", "files": ["*.tsx", "*.jsx"], "hints": [".map"]},
    {"id": "react-missing-dep-array",
     "regex": r"useEffect\s*\(\s*\(\)\s*=>\s*\{[^}]+\}\s*\)\s*;",
     "languages": ["javascript", "typescript"], "severity": "major", "category": "performance",
     "message": "useEffect without dependency array", "files": ["*.tsx", "*.jsx"],
     "hints": ["useEffect"]},
]
SERVERLESS = [
    {"id": "serverless-global-map", "regex": r"^(?:let|var)\s+\w+\s*=\s*new\s+Map",
     "languages": ["javascript", "typescript"], "severity": "critical", "category": "logic",
     "message": "In-memory Map in serverless — resets on cold start", "hints": ["Map"]},
    {"id": "serverless-global-set", "regex": r"^(?:let|var)\s+\w+\s*=\s*new\s+Set",
     "languages": ["javascript", "typescript"], "severity": "critical", "category": "logic",
     "message": "In-memory Set in serverless — resets on cold start", "hints": ["Set"]},
    {"id": "serverless-connection-no-reuse",
     "regex": r"new\s+(?:Client|Pool|Connection|MongoClient)\s*\(",
     "languages": ["javascript", "typescript", "python"], "severity": "major",
     "category": "performance", "message": "Database connection created inside handler",
     "hints": ["Client", "Pool", "Connection"]},
    {"id": "lambda-tmp-cleanup", "regex": r"/tmp/",
     "languages": ["javascript", "typescript", "python"], "severity": "minor",
     "category": "logic", "message": "Writing to /tmp on serverless", "hints": ["/tmp/"]},
]
# in the order in which the packs are read
DOMAIN_PACKS = {"api": API, "browser": BROWSER, "react": REACT, "serverless": SERVERLESS}
BUILT_IN = {
    "ai-patterns": AI_PATTERNS, **DOMAIN_PACKS, "performance": PERFORMANCE, "security": SECURITY,
}


@dataclass(frozen=True)
class LineRuleSpec:
    """A checked rule, ready to become a predicate."""

    rule_id: str
    regex: str
    exclude: str | None
    exts: tuple[str, ...]
    globs: tuple[str, ...]
    severity: str
    category: str
    message: str
    description: str = ""
    suggestion: str | None = None
    confidence: float = 0.8
    hints: tuple[str, ...] = ()
    source: str = "built-in"
    python: str = ""  # the regex as the rule has it


@dataclass
class RuleSet:
    rules: list[LineRuleSpec] = field(default_factory=list)
    errors: list[tuple[str, str]] = field(default_factory=list)


def java_regex(regex: str) -> str:
    """Spell the few Python constructs that Java reads differently."""
    shaped, words = shape(regex)
    return filled(_java_regex(shaped), words)


@lru_cache(4096)
def _java_regex(regex: str) -> str:
    regex = _java_groups(regex)
    out, in_class, i = "", False, 0
    while i < len(regex):
        ch = regex[i]
        if ch == "\\" and i + 1 < len(regex):
            out += r"\z" if regex[i + 1] == "Z" and not in_class else regex[i : i + 2]
            i += 2
            continue
        if in_class and ch in "[&":
            out += "\\" + ch
        else:
            out += ch
        if not in_class and ch == "[":
            in_class = True
            # a leading ']' (after '^') is literal in Python
            if regex.startswith("^]", i + 1):
                out += r"^\]"
                i += 2
            elif regex.startswith("]", i + 1):
                out += r"\]"
                i += 1
        elif in_class and ch == "]":
            in_class = False
        i += 1
    return out


def wildcard_regex(pattern: str) -> str:
    """Literal text in which ``$NAME`` stands for one run of non-blanks."""
    return r"\S+".join(re.escape(part) for part in re.split(r"\$[A-Z_]+", pattern))


def _compiles(rule_id: str, regex: str) -> None:
    """Raises ValueError if Java, which matches the lines, does not take the pattern (asked where a session runs)."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        spark._jvm.java.util.regex.Pattern.compile(java_regex(regex))
    except (Py4JJavaError, PySparkException) as e:
        raise ValueError(f"{rule_id}: {e}".split("\n")[0]) from e


def _group_name(name: str) -> str:
    if re.fullmatch("[A-Za-z][A-Za-z0-9]*", name):
        return name
    return "g" + re.sub("[^A-Za-z0-9]", lambda m: f"x{ord(m[0]):x}", name)


def _java_groups(regex: str) -> str:
    """Named groups, references to them and open lower bounds as Java writes them."""
    regex = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{_group_name(m[1])}>", regex)
    regex = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\k<{_group_name(m[1])}>", regex)
    return re.sub(r"(?<!\\)\{,(\d+)\}", r"{0,\1}", regex)


def check_rule(raw: dict, source: str = "built-in") -> LineRuleSpec:
    """Validate one rule; raises ValueError with the reason it cannot be used."""
    rule_id = raw.get("id", "custom-rule")
    regex, pattern = raw.get("regex"), raw.get("pattern")
    if regex:
        if len(regex) > MAX_REGEX:
            raise ValueError(f"{rule_id}: regex longer than {MAX_REGEX} characters")
        bad = [b for b in BACKTRACKING if b in regex]
        if bad:
            raise ValueError(f"{rule_id}: regex may backtrack without bound: {bad[0]}")
    elif pattern:
        regex = wildcard_regex(pattern)
    else:
        raise ValueError(f"{rule_id}: neither regex nor pattern")
    try:
        check_regex(regex)
    except re.error as e:
        raise ValueError(f"{rule_id}: {e}") from e
    _compiles(rule_id, regex)
    exclude = raw.get("pattern-not") or raw.get("regex-not")
    if exclude:
        try:
            check_regex(exclude)
        except re.error:
            exclude = None
    languages = raw.get("languages") or []
    exts = [e for lang in languages for e in LANGUAGE_EXTS.get(lang, [])]
    if languages and not exts:
        raise ValueError(f"{rule_id}: no known language in {languages}")
    category = str(raw.get("category", "logic")).lower()
    return LineRuleSpec(
        rule_id=rule_id,
        regex=java_regex(regex),
        exclude=java_regex(exclude) if exclude else None,
        exts=tuple(exts),
        globs=tuple(raw.get("files") or ()),
        severity=SEVERITY_NAMES.get(str(raw.get("severity", "major")).lower(), "major"),
        category=category if category in CATEGORY_NAMES else "logic",
        message=raw.get("message", rule_id),
        description=raw.get("description", ""),
        suggestion=raw.get("suggestion"),
        confidence=float(raw.get("confidence", 0.8)),
        hints=tuple(raw.get("hints") or ()),
        source=source,
        python=regex,
    )


def check_rules(raws: Iterable[dict], source: str = "built-in") -> RuleSet:
    out = RuleSet()
    for raw in raws:
        try:
            out.rules.append(check_rule(raw, source))
        except (ValueError, TypeError, AttributeError) as e:
            out.errors.append((source, str(e)))
    return out


def built_in(*packs: str) -> list[LineRuleSpec]:
    names = packs or tuple(BUILT_IN)
    return [check_rule(r, name) for name in names for r in BUILT_IN[name]]


def load_rule_dirs(dirs: Iterable[str], with_built_in: bool = True) -> RuleSet:
    """Built-in packs, then every rule file below ``dirs`` in path order.

    A file that cannot be read or parsed is reported in ``errors``; the others still load.
    """
    out = RuleSet(rules=built_in() if with_built_in else [])
    for d in dirs:
        root = Path(d)
        files = sorted(p for p in root.rglob("*") if p.suffix in (".yaml", ".yml", ".json"))
        for file in files:
            try:
                text = file.read_text()
                if file.suffix == ".json":
                    data = json.loads(text)
                elif yaml is None:
                    raise ValueError("PyYAML is not installed")
                else:
                    data = yaml.safe_load(text)
                raws = (data or {}).get("rules") or []
            except Exception as e:  # noqa: BLE001 - one bad file must not stop the others
                out.errors.append((str(file), str(e).split("\n")[0]))
                continue
            part = check_rules(raws, str(file))
            out.rules += part.rules
            out.errors += part.errors
    return out
