"""Architecture and runtime checks that look at a file, its neighbours and the deployment.

All checks on source files are detectors of one line pass.  Checks on a whole file are decided
before its lines are exploded and attached to one line of it, so they ride along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.predicates import both, case, group, has, match, text
from sievework.functions.skew import join_key
from sievework.functions.text import contains_any, dialect, fixed_point, line_at, suffix
from sievework.operators.findings import dedupe
from sievework.operators.index import state_line
from sievework.operators.lines import IN_SCRIPT, Detector, describe, line_hits
from sievework.operators.packs import DEEP_PACK_EXTS, pack_detectors
from sievework.schema import Rule, to_findings, union_all
from sievework.sources.files import config_files, in_asset_dir, index_files
from sievework.sources.rules import DOMAIN_PACKS, built_in

# Directories, patterns, limits, severities, confidences and titles.
SERVER_DIRS = ["api/", "functions/", "pages/api/", "app/api/", "server/", "lambda/"]
ROUTE_DIRS = ["api/", "functions/", "pages/api/", "app/api/"]
STATE_KINDS = [
    (r"(?:cache|Cache|CACHE)", "cache"),
    (r"(?:rate|Rate|limit|Limit|throttle)", "rate limiter"),
    (r"(?:session|Session|SESSION)", "session store"),
    (r"(?:counter|count|COUNT)", "counter"),
    (r"(?:Map|map|dict|Dict)\s*\(", "in-memory map"),
    (r"\{\s*\}", "in-memory object"),
    (r"\[\s*\]", "in-memory array"),
]
CORS_ANY = r"""(?:cors|CORS|origin|Origin)\s*[:=]\s*['"]?\*['"]?"""
TIMEOUT = r"timeout\s*[:=]\s*(\d+)"
TIMEOUT_LIMITS = {"vercel": 30, "netlify": 26, "aws-lambda": 900}
DEFAULT_LIMIT = 30
SELF_CALL = r"""(?:fetch|axios|http)\s*\(\s*['"`](?:https?://.*)?/api/"""
ADD_NAMED = r"""addEventListener\s*\(\s*['"](\w+)['"]\s*,\s*(\w+)"""
ADD_ANY = r"""addEventListener\s*\(\s*['"](\w+)['"]"""
REMOVE = r"""removeEventListener\s*\(\s*['"](\w+)['"]\s*,\s*(\w+)"""
ASYNC_EVENT = r"(?:onclick|addEventListener|\.on\()\s*.*(?:async|await|fetch|\.then)"
HTTP_CALL = r"(?:(?<!\.)fetch\s*\(|axios\.\w+\s*\(|requests\.\w+\s*\(|httpx\.\w+\s*\(|urllib\.request)"
NOT_CODE = r"""^\s*(?:#|//|\*|"|')"""
CURSOR_FETCH = r"\.fetch(?:one|all|many)\s*\("
FILE_INPUT = r"""(?:type\s*=\s*['"]file['"]|\.files\[|FileReader|readAsArrayBuffer)"""
SIZE_CHECK = r"\.size\s*[><=]|maxSize|MAX_SIZE|file_size|fileSize"
CACHED_DIRS = ["public", "static", "assets", "dist"]
CACHED_EXTS = [".wasm", ".js", ".css", ".woff2", ".woff", ".ttf", ".otf"]
MEGABYTE = 1024 * 1024


def _same_line(pattern: str) -> str:
    """The pattern for a whole file, where white space must not cross a line end."""
    return pattern.replace(r"\s", r"[^\S\n]")


# SQL over ``line``: kind of state, seconds of the first timeout (values above 1000 are taken as
# milliseconds), and the limit of a platform.
STATE_KIND = case(*[(match("line", p), text(name)) for p, name in STATE_KINDS], default="'mutable state'")
_TIMEOUT = f"try_cast(nullif({group('line', TIMEOUT, ignore_case=True)}, '') AS BIGINT)"
SECONDS = f"CASE WHEN {_TIMEOUT} > 1000 THEN {_TIMEOUT} DIV 1000 ELSE {_TIMEOUT} END"
LIMIT = case(*[(f"deployment = {text(n)}", str(v)) for n, v in TIMEOUT_LIMITS.items()], default=str(DEFAULT_LIMIT))
NAMED_EVENT = f"nullif({group('line', ADD_NAMED)}, '')"
EVENT = f"coalesce({NAMED_EVENT}, {group('line', ADD_ANY)})"


def with_file_facts(files: DataFrame) -> DataFrame:
    """What the line checks need to know about the whole file, from its own content.

    ``removed_events``: events some listener is removed from; ``input_line``: first file input
    of a script without a size check; ``cors_line``: first wildcard origin.
    """
    removed = (
        f"CASE WHEN {IN_SCRIPT} AND contains(content, 'removeEventListener') THEN "
        f"transform(filter(split(content, '\\n', -1), l -> contains(l, 'removeEventListener')), "
        f"l -> {group('l', REMOVE)}) ELSE CAST(array() AS array<string>) END"
    )
    input_at = (
        f"CASE WHEN {IN_SCRIPT} AND {has('content', 'file', '.files[', 'FileReader', 'readAsArrayBuffer')} "
        f"AND NOT {match('content', _same_line(SIZE_CHECK))} "
        f"THEN nullif(regexp_instr(content, {text(dialect(_same_line(FILE_INPUT)))}), 0) END"
    )
    cors_at = (
        f"CASE WHEN {has('content', 'cors', 'CORS', 'origin', 'Origin')} "
        f"THEN nullif(regexp_instr(content, {text(dialect(_same_line(CORS_ANY)))}), 0) END"
    )
    return files.select(
        "*",
        F.expr(removed).alias("removed_events"),
        F.expr("contains(content, 'revokeObjectURL')").alias("has_revoke"),
        line_at(F.col("content"), F.expr(input_at)).alias("input_line"),
        line_at(F.col("content"), F.expr(cors_at)).alias("cors_line"),
    )


FILE_FACTS = ["removed_events", "has_revoke", "input_line", "cors_line"]

# an effect listens and no 'return' comes before its dependency list
_RETURNS = "(effect_return IS NOT NULL AND (effect_deps IS NULL OR effect_return < effect_deps))"
EFFECT_LEAKS = f"effect_listens AND NOT {_RETURNS}"
# parity: without a dependency list ahead any non-empty look-ahead counts
EFFECT_LEAKS_PARITY = (
    f"CASE WHEN effect_deps IS NOT NULL THEN {EFFECT_LEAKS} "
    f"ELSE effect_filled OR effect_last > line_no + 1 END"
)


def _rule(rule_id, severity, category, confidence, title, why, remedy) -> Rule:
    return Rule(rule_id, severity, category, confidence, "deep", title, why, remedy)


CORS_RULE = _rule("cors-wildcard-api", "critical", "security", 0.9, "CORS wildcard allows any website to use your API",
                  "Any site may call this API on a visitor's behalf.", "Name the allowed origins.")


def deep_detectors(parity: bool = False) -> list[Detector]:
    """The checks on source files in reporting order.

    The project's context (serverless, web application, API) is joined after the pass.
    """
    return [
        Detector(
            _rule("serverless-stateful-code", "critical", "logic", 0.85, "Stateful mutable state in serverless function",
                  "Module state is lost at every cold start.", "Keep it in an external store."),
            both(has("path", *SERVER_DIRS), state_line("line")),
            title=f"concat('Stateful ', {STATE_KIND}, ' in serverless function')",
        ),
        Detector(CORS_RULE, "line_no = cors_line", with_evidence=False),
        Detector(
            _rule("timeout-exceeds-platform", "major", "logic", 0.7, "Timeout exceeds platform limit",
                  "The platform ends the call before this timeout.", "Stay below the platform limit, or retry."),
            both(has("lower(line)", "timeout"), f"{_TIMEOUT} IS NOT NULL"),
            title=f"concat('Timeout (', {SECONDS}, 's) exceeds ', deployment, ' limit (', {LIMIT}, 's)')",
        ),
        Detector(
            _rule("recursive-serverless-invocation", "critical", "logic", 0.6, "Possible recursive serverless invocation",
                  "An API route calls its own API over HTTP.", "Call the function directly."),
            both(has("path", *ROUTE_DIRS), match("line", SELF_CALL, hints=["/api/"])),
        ),
        Detector(
            _rule("event-listener-leak", "major", "performance", 0.75, "Event listener never removed",
                  "Each run adds one more handler.", "Remove it on teardown."),
            # an anonymous handler, or an event nothing in the file is removed from
            both(
                IN_SCRIPT, match("line", ADD_ANY, hints=["addEventListener"]),
                f"{NAMED_EVENT} IS NULL OR NOT array_contains(removed_events, {NAMED_EVENT})",
            ),
            title=f"concat('Event listener \\'', {EVENT}, '\\' never removed')",
            with_evidence=False,
        ),
        Detector(
            _rule("blob-url-leak", "major", "performance", 0.85, "Blob URL created but never revoked",
                  "The blob stays in memory until it is revoked.", "Revoke the URL after use."),
            both(IN_SCRIPT, has("line", "createObjectURL"), "NOT has_revoke"),
            with_evidence=False,
        ),
        Detector(
            _rule("useeffect-missing-cleanup", "major", "performance", 0.8, "useEffect adds listener without cleanup",
                  "Every render adds a listener.", "Return a function that removes it."),
            both(IN_SCRIPT, has("line", "useEffect")),
            needs=("effect_ahead", "effect_block") if parity else ("effect_ahead",),
            keep=EFFECT_LEAKS_PARITY if parity else EFFECT_LEAKS,
            with_evidence=False,
        ),
        Detector(
            _rule("unguarded-async-handler", "major", "logic", 0.6, "Async operation without re-entry guard",
                  "A second event can start the work again before it ends.", "Check and set a busy flag."),
            both(IN_SCRIPT, match("line", ASYNC_EVENT, hints=["onclick", "addEventListener", ".on("])),
            needs=("guarded",),
            keep="NOT guarded",
            with_evidence=False,
        ),
        Detector(
            _rule("missing-api-timeout", "major", "logic", 0.7, "External API call without timeout",
                  "A remote that hangs makes this hang too.", "Set a timeout."),
            both(
                match("line", HTTP_CALL, hints=["fetch", "axios.", "requests.", "httpx.", "urllib.request"]),
                f"NOT {match('line', CURSOR_FETCH, hints=['.fetch'])}",
                f"NOT {match('line', NOT_CODE)}",
            ),
            needs=("timeout_near",),
            keep="NOT timeout_near",
        ),
        Detector(
            _rule("missing-filesize-validation", "major", "logic", 0.8, "File upload without size validation",
                  "A file of any size is accepted.", "Check the size before reading the file."),
            "line_no = input_line",
            with_evidence=False,
        ),
    ]


NEEDS_SERVERLESS = ["serverless-stateful-code", "timeout-exceeds-platform", "recursive-serverless-invocation"]
NEEDS_CONTEXT = [*NEEDS_SERVERLESS, "missing-filesize-validation", "cors-wildcard-api"]


def code_checks(
    files: DataFrame, context: DataFrame, packs: bool = False, parity: bool = False,
    only: tuple[str, ...] = (),
) -> DataFrame:
    """Findings on source files: one pass, then one join with the project context.

    ``only`` limits the pass to some rule ids.
    """
    detectors = [d for d in deep_detectors(parity) if not only or d.rule.rule_id in only]
    if packs:
        detectors += pack_detectors(built_in(*DOMAIN_PACKS), DEEP_PACK_EXTS)
    hits = line_hits(with_file_facts(index_files(files)), detectors, *FILE_FACTS)
    flags = ["is_serverless", "is_web_app", "is_api"]
    dims = context.select(F.col("project").alias("_p"), "deployment", *flags)
    # only some rules look at the context; the other hits get places of their own in the join
    asked = F.col("det").isin(*[i for i, d in enumerate(detectors) if d.rule.rule_id in NEEDS_CONTEXT])
    h = hits.drop(*FILE_FACTS).withColumn("_k", join_key("project", asked, "path", "line_no", "det"))
    h = h.join(dims, F.col("_k") == F.col("_p"), "left").drop("_k")
    h = h.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})
    ids = [d.rule.rule_id for d in detectors]

    def unless(rule_id: str, cond: str) -> str:
        return f"(det <> {ids.index(rule_id)} OR ({cond}))" if rule_id in ids else "true"

    h = h.where(
        both(
            *[unless(r, "is_serverless") for r in NEEDS_SERVERLESS],
            unless("timeout-exceeds-platform", f"{SECONDS} > {LIMIT}"),
            unless("missing-filesize-validation", "is_web_app"),
            unless("cors-wildcard-api", "is_api"),
        )
    )
    return describe(h, detectors)


def config_cors(files: DataFrame, context: DataFrame) -> DataFrame:
    """Wildcard origin in the platform configuration of an API project."""
    c = F.col("content")
    star = '"*"'
    open_cors = c.contains(star) & F.lower(c).contains("access-control")
    hits = (
        config_files(files).where((F.col("name") == "vercel.json") & open_cors)
        .join(context.where("is_api").select("project"), "project", "left_semi")
    )
    return to_findings(
        hits, CORS_RULE, file=F.col("name"), line_no=line_at(c, F.instr(c, star)), order=-1
    )


NO_CACHE = Rule("missing-cache-headers", "major", "performance", 0.8, "deep",
                "Large asset without cache headers", "Every visit downloads it again.",
                "Send Cache-Control headers for static assets.")


def uncached_assets(assets: DataFrame, files: DataFrame) -> DataFrame:
    """Static assets of at least a megabyte in projects whose configuration sets no caching."""
    path, c = F.col("path"), F.col("content")
    cached = config_files(files).where(
        (F.col("name") == "vercel.json") & contains_any(c, ["Cache-Control", "cache-control"])
    )
    large = assets.where(
        in_asset_dir(path, CACHED_DIRS)
        & suffix(path).isin(*CACHED_EXTS)
        & (F.col("size_bytes") >= MEGABYTE)
    )
    hits = large.join(cached.select("project"), "project", "left_anti")
    size = fixed_point(F.col("size_bytes"), MEGABYTE, 1)
    return to_findings(
        hits, NO_CACHE, file=path, order=len(deep_detectors()),
        title=F.concat(F.lit("Large asset without cache headers ("), size, F.lit("MB)")),
    )


def deep_findings(
    files: DataFrame, context: DataFrame, assets: DataFrame | None = None,
    packs: bool = False, parity: bool = False,
) -> DataFrame:
    """Every deep check, deduplicated; the wildcard-CORS rule reports once per project."""
    parts = [code_checks(files, context, packs, parity), config_cors(files, context)]
    if assets is not None:
        parts.append(uncached_assets(assets, files))
    return dedupe(union_all(parts), once_per_project=("cors-wildcard-api",))

