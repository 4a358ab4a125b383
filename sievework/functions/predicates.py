"""SQL text of predicates.

Rules are many and small.  Written as SQL text each needs one call into the JVM instead of one
per operator, which is most of the time a small job spends before it starts.
"""

from __future__ import annotations

from collections.abc import Iterable

from sievework.functions.text import dialect


def text(value: str | None) -> str:
    """A SQL string literal; a '${' in it is not taken for a session variable."""
    if value is None:
        return "CAST(NULL AS STRING)"
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("${", "\\u0024{")
    return f"'{escaped}'"


def isin(col: str, values: Iterable[str]) -> str:
    inside = ", ".join(text(v) for v in values)
    return f"{col} IN ({inside})" if inside else "false"


def either(conds: Iterable[str]) -> str:
    conds = list(conds)
    return "(" + " OR ".join(f"({c})" for c in conds) + ")" if conds else "false"


def both(*conds: str) -> str:
    return "(" + " AND ".join(f"({c})" for c in conds) + ")"


def has(col: str, *needles: str) -> str:
    """``col`` contains one of the needles."""
    return either(f"contains({col}, {text(n)})" for n in needles)


def starts(col: str, *prefixes: str) -> str:
    return either(f"startswith({col}, {text(p)})" for p in prefixes)


def match(col: str, pattern: str, ignore_case: bool = False, hints: Iterable[str] = ()) -> str:
    """``col`` contains a match of ``pattern``.

    ``hints`` are substrings of which every match must contain at least one.  They are byte
    searches, so most lines never reach the regex (nor its UTF-8 decoding).
    """
    test = f"{col} RLIKE {text(dialect(pattern, ignore_case))}"
    hints = list(hints)
    return both(has(col, *hints), test) if hints else f"({test})"


def group(col: str, pattern: str, number: int = 1, ignore_case: bool = False) -> str:
    """Captured group of the first match, '' without one."""
    return f"regexp_extract({col}, {text(dialect(pattern, ignore_case))}, {number})"


def case(*branches: tuple[str, str], default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {c} THEN {v}" for c, v in branches)
    return f"CASE {whens} ELSE {default} END" if branches else default
