"""One pass over source lines for any number of detectors.

A detector is a predicate on a line plus, optionally, a condition on what surrounds the line
in its file (an open block comment, the loop depth, a guard a few lines away).  All detectors
of a job are evaluated in the same projection right after the explode.  Only lines that are a
hit, or that carry a flag some hit needs, go on; of those without a hit just the key, the line
number and the flags.  One exchange on (project, path) then serves every window, because the
frames are ranges of ``line_no`` and so do not need the dropped lines.  Without a window there
is no exchange at all.

Predicates are SQL text over the columns project, path, ext, language and line (and columns a
job adds per file); conditions see the columns of the signals they need.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.predicates import both, case, either, has, isin, match, text
from sievework.functions.text import strip
from sievework.schema import FILE, Rule

# Extension sets of the detector families.
PYTHON = (".py",)
SCRIPT = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")
SCRIPT_LOOPS = (".js", ".jsx", ".ts", ".tsx")
SCRIPT_LANGUAGES = ("javascript", "typescript")

# Patterns of the line context.
LOOP_OPEN = r"\b(?:for|while|forEach|\.map|\.filter|\.reduce)\s*\("
LOOP_HINTS = ("for", "while", ".map", ".filter", ".reduce")
GUARD = r"(?:isProcessing|isLoading|isBusy|isRunning|disabled|loading)"

# whole-line comment after stripping: '#', '//' or '*'
COMMENT_LINE = match("line", r"^\s*(?:#|//|\*)")
# only a string, or touching a triple-quoted one
LITERAL_LINE = either([match("line", r"""^\s*(?:"|'|f')"""), has("line", '"""', "'''")])
# defines a pattern rather than uses it
DEFINITION_LINE = has("line", "re.compile", "Pattern")
IN_SCRIPT = isin("language", SCRIPT_LANGUAGES)


# Characters detectors are grouped by, the one that most of them share first.
SIGNS = "({=<:.'\"`"

# Many predicates in one whole-stage method pass the size up to which the JVM compiles a method,
# and run several times slower.  A term that whole-stage generation does not take makes Spark
# generate the filter by itself, in small methods.  The term is false for every line of text.
SPLIT = "exists(array(line), x -> x = '\\0')"


@dataclass(frozen=True)
class Signal:
    """Per-line flags and the windows that turn them into context for other lines.

    ``gate`` is evaluated once per file: where it is false the file cannot have a hit that
    looks at this signal, and its flag lines are not shuffled.  Window columns named ``w_…``
    are steps on the way.
    """

    gate: str
    flags: dict[str, str]
    windows: Callable[[], list[tuple[str, Column]]]


@dataclass(frozen=True)
class Detector:
    rule: Rule
    match: str
    needs: tuple[str, ...] = ()
    keep: str | None = None
    title: str | None = None  # SQL, where the title depends on the line
    with_evidence: bool = True
    file_level: bool = False  # the finding has a file but no line
    signs: str = ""  # characters that every line it matches has


def explode_lines(files: DataFrame, *keep: str) -> DataFrame:
    """1-based lines of every file; empty lines at the end stay."""
    return files.select(
        *FILE, "ext", "language", *keep, F.posexplode(F.split("content", "\n", -1)).alias("pos", "line")
    ).select(*FILE, "ext", "language", *keep, (F.col("pos") + 1).alias("line_no"), "line")


def evidence(line: Column) -> Column:
    return F.substring(strip(line), 1, 200)


def _file_window():
    return Window.partitionBy(*FILE).orderBy("line_no")


def _before():
    return _file_window().rowsBetween(Window.unboundedPreceding, -1)


def _so_far():
    return _file_window().rowsBetween(Window.unboundedPreceding, 0)


def _by_line(first: int, last: int):
    return _file_window().rangeBetween(first, last)


def _near(flag: str, first: int, last: int) -> Column:
    return F.coalesce(F.max(flag).over(_by_line(first, last)), F.lit(False))


def _true(cond: str) -> str:
    """True or null, so that a false flag does not keep a line."""
    return f"CASE WHEN {cond} THEN true END"


def _mark(needle: str) -> str:
    """Place of the needle: line, then character."""
    n = text(needle)
    return f"CASE WHEN contains(line, {n}) THEN struct(line_no, instr(line, {n}) AS at) END"


def _block_windows() -> list[tuple[str, Column]]:
    last = F.last("f_block", ignorenulls=True).over(_before())
    return [("in_block", F.coalesce(last, F.lit(False)))]


def _sql_windows() -> list[tuple[str, Column]]:
    mark, bound, names = (_near(f, -24, 10) for f in ("f_mark", "f_bound", "f_names"))
    return [("sql_safe", (mark & bound) | names)]


def _loop_windows() -> list[tuple[str, Column]]:
    # depth after a line is max(0, depth before + opened - closed); with S the running sum of
    # opened - closed this is S - min(0, running minimum of S)
    opened = F.coalesce(F.col("f_opened"), F.lit(0))
    net = opened - F.coalesce(F.col("f_closed"), F.lit(0))
    return [
        ("w_net", F.sum(net).over(_so_far())),
        ("w_depth", F.col("w_net") - F.least(F.lit(0), F.min("w_net").over(_so_far()))),
        ("loop_depth", F.coalesce(F.lag("w_depth").over(_file_window()), F.lit(0)) + opened),
    ]


def _effect_windows() -> list[tuple[str, Column]]:
    return [
        ("effect_listens", _near("f_listen", 1, 30)),
        ("effect_return", F.min("f_return").over(_by_line(1, 30))),
        ("effect_deps", F.min("f_deps").over(_by_line(1, 30))),
    ]


def _effect_block_windows() -> list[tuple[str, Column]]:
    return [
        ("effect_filled", _near("f_filled", 1, 30)),
        ("effect_last", F.coalesce(F.max("line_no").over(_by_line(1, 30)), F.lit(0))),
    ]


_OPENS = "contains(line, '/*') AND NOT contains(line, '*/')"
_CLOSES = "contains(line, '*/') AND NOT contains(line, '/*')"

SIGNALS: dict[str, Signal] = {
    # true where a block comment opens, false where one closes
    "in_block": Signal(
        "contains(content, '/*')",
        {"f_block": case((_OPENS, "true"), (_CLOSES, "false"))},
        _block_windows,
    ),
    "sql_safe": Signal(
        either(
            [
                both(isin("ext", PYTHON), has("content", "execute")),
                both(isin("ext", SCRIPT), has("content", "query", "sql")),
            ]
        ),
        {
            "f_mark": _true("contains(line, '?')"),
            "f_bound": _true(
                either([has("line", "placeholders", "params", ", vals"), has("upper(line)", "VALUES (")])
            ),
            "f_names": _true(
                either(
                    [
                        has("line", "for table in", "for col in"),
                        match("line", r"""col\s*=\s*["']""", hints=["col"]),
                    ]
                )
            ),
        },
        _sql_windows,
    ),
    "loop_depth": Signal(
        both(isin("ext", SCRIPT_LOOPS), has("content", "fetch", "axios", "http", "document.querySelector")),
        {
            "f_opened": f"CASE WHEN {match('line', LOOP_OPEN, hints=LOOP_HINTS)} THEN 1 END",
            "f_closed": "CASE WHEN contains(line, '}') THEN length(line) - length(replace(line, '}', '')) END",
        },
        _loop_windows,
    ),
    "guarded": Signal(
        both(IN_SCRIPT, has("content", "onclick", "addEventListener", ".on(")),
        {"f_guard": _true(match("line", GUARD))},
        lambda: [("guarded", _near("f_guard", -9, 20))],
    ),
    "timeout_near": Signal(
        has("content", "fetch", "axios", "requests", "httpx", "urllib"),
        {"f_timeout": _true(has("lower(line)", "timeout"))},
        lambda: [("timeout_near", _near("f_timeout", -2, 5))],
    ),
    # first 'return' against the first dependency list in the 30 lines after an effect
    "effect_ahead": Signal(
        both(IN_SCRIPT, has("content", "useEffect")),
        {
            "f_listen": _true("contains(line, 'addEventListener')"),
            "f_return": _mark("return"),
            "f_deps": _mark("}, ["),
        },
        _effect_windows,
    ),
    "effect_block": Signal(
        both(IN_SCRIPT, has("content", "useEffect")),
        {"f_filled": "line <> ''"},
        _effect_block_windows,
    ),
}


def _by_sign(detectors: Sequence[Detector]) -> list[str]:
    """The detectors' matches, those that ask for the same character together behind one search for it: most prose has none."""
    groups: dict[str, list[str]] = {}
    for d in detectors:
        groups.setdefault(next((c for c in SIGNS if c in d.signs), ""), []).append(d.match)
    return [both(has("line", sign), either(some)) if sign else either(some) for sign, some in groups.items()]


def line_hits(files: DataFrame, detectors: Sequence[Detector], *keep: str) -> DataFrame:
    """(project, path, ext, keep…, line_no, det, line, signal columns): a row per detector hit.

    ``files`` needs project, path, ext, language and content; ``keep`` names further columns
    of it that the predicates use.
    """
    needs = sorted({n for d in detectors for n in d.needs})
    gates = [F.expr(f"{SIGNALS[n].gate} AS g_{n}") for n in needs]
    lines = explode_lines(files.select("*", *gates), *keep, *[f"g_{n}" for n in needs])

    flags = {
        name: f"CASE WHEN g_{n} THEN {flag} END" for n in needs for name, flag in SIGNALS[n].flags.items()
    }
    wanted = [f"({f}) IS NOT NULL" for f in flags.values()] + _by_sign(detectors) + [SPLIT]
    hits = ", ".join(f"CASE WHEN {d.match} THEN {i} END" for i, d in enumerate(detectors))
    slim = lines.where(either(wanted)).select(
        *FILE, "ext", *keep, "line_no", F.expr(f"array_compact(array({hits})) AS hits"), "line",
        *[F.expr(f"{f} AS {name}") for name, f in flags.items()],
    ).withColumn("line", F.when(F.size("hits") > 0, F.col("line")))

    context = []
    for n in needs:
        for name, col in SIGNALS[n].windows():
            slim = slim.withColumn(name, col)
            context += [] if name.startswith("w_") else [name]

    each = slim.where(F.size("hits") > 0).withColumn("det", F.explode("hits"))
    checks = [f"(det <> {i} OR ({d.keep}))" for i, d in enumerate(detectors) if d.keep]
    if checks:
        each = each.where(" AND ".join(checks))
    return each.select(*FILE, "ext", *keep, "line_no", "det", "line", *context)


def line_signals(files: DataFrame, *names: str) -> DataFrame:
    """Every line of ``files`` with the context columns of the named signals."""
    every = Detector(Rule("line", "info", "style", 1.0, "code", ""), "true", needs=names)
    return line_hits(files, [every]).drop("det")


def line_findings(files: DataFrame, detectors: Sequence[Detector], *keep: str) -> DataFrame:
    """Findings of ``detectors``; ``keep`` names file columns to carry along."""
    return describe(line_hits(files, detectors, *keep), detectors, *keep)


def _facts(d: Detector) -> str:
    r = d.rule
    return (
        f"named_struct('rule_id', {text(r.rule_id)}, 'severity', {text(r.severity)}, "
        f"'category', {text(r.category)}, 'title', {text(r.title)}, 'description', {text(r.why)}, "
        f"'suggestion', {text(r.remedy)}, 'confidence', {float(r.confidence)!r}D, "
        f"'engine', {text(r.engine)}, 'quoted', {str(d.with_evidence).lower()}, "
        f"'file_level', {str(d.file_level).lower()})"
    )


def describe(hits: DataFrame, detectors: Sequence[Detector], *keep: str) -> DataFrame:
    """Attach what each detector says; the literals never travel through the shuffle."""
    facts = ", ".join(_facts(d) for d in detectors)
    titles = [(f"det = {i}", d.title) for i, d in enumerate(detectors) if d.title]
    m = hits.withColumn("m", F.expr(f"element_at(array({facts}), det + 1)"))
    return m.select(
        "project",
        F.col("path").alias("file"),
        F.expr("CASE WHEN NOT m.file_level THEN CAST(line_no AS INT) END AS line_no"),
        F.expr("CAST(NULL AS INT) AS end_line"),
        "m.rule_id",
        "m.severity",
        "m.category",
        F.expr(f"{case(*titles, default='m.title')} AS title"),
        "m.description",
        "m.suggestion",
        "m.confidence",
        "m.engine",
        F.when(F.col("m.quoted"), evidence(F.col("line"))).alias("evidence"),
        F.col("det").alias("ord"),
        F.lit(0).cast("long").alias("seq"),
        *keep,
    )
