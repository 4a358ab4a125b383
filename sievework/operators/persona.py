"""Who uses the project, and what would get in their way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.predicates import both, case, either, group, has, isin, match, text
from sievework.functions.skew import join_key
from sievework.functions.text import contains_any, dialect, file_name, fixed_point, has_part
from sievework.operators.lines import Detector, describe, line_hits
from sievework.schema import Rule, to_findings, union_all
from sievework.sources.files import in_asset_dir, readmes

# Directories and extensions of each check.
SKIP = ["node_modules", "__pycache__", ".git", "dist", "build", ".next", ".vercel", "venv"]
SKIP_CODE = ["node_modules", "__pycache__", ".git", "dist", "build", ".next", ".vercel"]
SKIP_DOCS = ["node_modules", "__pycache__", ".git", "dist", "build"]
SKIP_STYLE = ["node_modules", ".next", "dist", "build"]
SIGNAL_EXTS = [".py", ".js", ".jsx", ".ts", ".tsx", ".html", ".css", ".scss"]
UI_EXTS = [".tsx", ".jsx", ".html", ".vue", ".svelte"]
COMPONENT_EXTS = [".tsx", ".jsx", ".vue", ".svelte"]
TEXT_EXTS = [".tsx", ".jsx", ".html"]
CODE_EXTS = [".py", ".js", ".jsx", ".ts", ".tsx"]
ROUTE_EXTS = [".py", ".ts", ".js"]
ASSET_DIRS = ["public", "static", "assets"]

# Words that show a feature, looked for in lower-cased content.
SIGNAL_WORDS = {
    "has_auth": ["login", "signup", "sign-up", "register", "auth", "password", "oauth"],
    "has_onboarding": ["onboarding", "welcome", "getting-started", "tour"],
    "has_responsive_css": ["@media", "responsive", "mobile-first", "breakpoint"],
    "has_file_upload": ['type="file"', "filereader", "upload", "dropzone"],
    "has_video_audio": ["video", "audio", "ffmpeg", "mediarecorder", "webrtc"],
    "has_payments": ["stripe", "razorpay", "payment", "checkout", "billing"],
    "has_api_docs": ["swagger", "openapi", "api-docs", "redoc"],
    "has_i18n": ["i18n", "intl", "locale", "translation", "t("],
    "has_accessibility": ["aria-", "role=", "sr-only", "screen-reader", "a11y"],
    "has_data_tables": ["<table", "datagrid", "data-table", "spreadsheet"],
    "has_forms": ["<form", "onsubmit", "handlesubmit", "useform"],
    "has_search": ["search", "filter", "query"],
    "has_notifications": ["notification", "toast", "alert", "snackbar"],
    "has_export": ["export", "download", "csv", "pdf", "xlsx"],
    "has_roles": ["role", "permission", "rbac", "isadmin", "is_admin"],
}
DOC_WORDS = ["swagger", "openapi", "api-doc", "redoc"]

# Patterns of the samples and of the checks, caps of the samples.
ROUTES = r"""(?:path|route)\s*[:=]\s*['"]([^'"]+)['"]"""
MESSAGES = r"""(?:error|Error|message)\s*[:=]\s*['"]([^'"]{10,80})['"]"""
UI_TEXT = r">([A-Z][^<]{5,60})</"
PER_FILE = 20
SAMPLE_CAPS = {"page_routes": 30, "error_messages": 20, "ui_text_samples": 20}
JARGON = (
    r">[^<]*\b(API|JSON|HTTP|CORS|DNS|SSL|TLS|JWT|OAuth|webhook|endpoint|payload|schema|runtime|"
    r"stack trace|exception|null|undefined|NaN)\b[^<]*<"
)
ERROR_CODE = r">[^<]*\b(?:error\s*code|status\s*\d{3}|errno|exit\s*code)\b[^<]*<"
COMMENTED = r"^\s*(?://|#)"
UNFRIENDLY = [
    (r"(?:err|error)\.(?:message|stack|toString)", "Raw error object exposed to user"),
    (r"(?:throw|raise)\s+(?:new\s+)?(?:Error|Exception)\s*\(\s*`", "Template literal in thrown error might reach UI"),
    (r"console\.error\s*\(.*\)\s*;?\s*$", "Error logged to console but not shown to user"),
]
FETCHES = r"(?:useQuery|useSWR|fetch\(|axios\.|useEffect.*fetch)"
LOADING = r"(?:loading|isLoading|isPending|skeleton|spinner|Loader)"
RENDERS = r"\.map\s*\(\s*\("
EMPTY = r"(?:\.length\s*===?\s*0|empty|no\s+(?:results|data|items))"
TOUCH = [":focus", ":active", "@media (hover:"]
HOVER_SPAN = 200
MEGABYTE = 1024 * 1024
LARGE_MB = 5

# The personas (name, role, tech level, devices).
PERSONAS = {
    "creator": ("Content Creator", "primary", "non-technical", ["desktop", "mobile"]),
    "business": ("Business User", "primary", "moderate", ["desktop"]),
    "developer": ("Developer", "primary", "developer", ["desktop"]),
    "user": ("End User", "primary", "non-technical", ["desktop", "mobile"]),
    "admin": ("Administrator", "secondary", "moderate", ["desktop"]),
    "visitor": ("First-Time Visitor", "tertiary", "non-technical", ["desktop", "mobile"]),
    "mobile": ("Mobile User", "secondary", "non-technical", ["mobile"]),
}
FLOWS = {
    "creator": ["upload", "process", "preview", "export", "download"],
    "business": ["login", "view dashboard", "filter data", "export report"],
    "developer": ["read docs", "get API key", "make first call", "handle errors"],
    "user": ["sign up", "complete main task", "view results"],
    "admin": ["manage users", "change settings", "view logs", "assign roles"],
    "visitor": ["land on homepage", "understand value prop", "sign up or try demo"],
    "mobile": ["open on phone", "navigate to main feature", "complete task with touch"],
}
# (description, goals, pain points)
STORIES = {
    "creator": (
        "Creates and uploads content. Expects simple, visual workflows.",
        ["Upload and process content quickly", "Get results without technical knowledge"],
        ["Confusing error messages", "No progress feedback", "Too many options"],
    ),
    "business": (
        "Uses dashboards and reports for decision-making.",
        ["View key metrics at a glance", "Export data for presentations"],
        ["Slow loading dashboards", "Can't find specific data", "No mobile access"],
    ),
    "developer": (
        "Integrates with the API. Needs clear docs and fast responses.",
        ["Integrate quickly", "Find the right endpoint", "Handle errors gracefully"],
        ["Outdated docs", "Unclear error codes", "No code examples"],
    ),
    "user": (
        "General user of the application.",
        ["Complete their task quickly", "Understand what to do next"],
        ["Confusing navigation", "No feedback on actions", "Unclear errors"],
    ),
    "admin": (
        "Manages users, settings, and system configuration.",
        ["Manage user accounts", "Configure system settings", "Monitor activity"],
        ["No bulk operations", "Audit trail missing", "Role management unclear"],
    ),
    "visitor": (
        "Has never seen this product before. Needs to understand what it does in seconds.",
        ["Understand what this product does", "Try it out quickly", "Decide if it's worth using"],
        ["No clear value proposition", "Complex signup", "No free trial or demo"],
    ),
    "mobile": (
        "Accesses the app primarily on phone. Needs touch-friendly, fast-loading UI.",
        ["Complete tasks on the go", "Quick access to key features"],
        ["Tiny touch targets", "Slow loading on 4G", "Desktop-only features"],
    ),
}
SIGNALS = ["has_admin", "has_dashboard", "has_mobile_meta", *SIGNAL_WORDS]


def _signal_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("ext").isin(*SIGNAL_EXTS) & ~has_part(F.col("path"), SKIP))


def project_signals(files: DataFrame) -> DataFrame:
    """One row per project with its eighteen feature flags: one pass, partial booleans."""
    flags = {name: has("text", *words) for name, words in SIGNAL_WORDS.items()}
    flags["has_admin"] = has("rel", "admin", "dashboard")
    flags["has_dashboard"] = either([has("text", "dashboard"), has("rel", "dashboard")])
    flags["has_mobile_meta"] = both(has("text", "viewport"), has("text", "width=device-width"))
    lowered = _signal_files(files).select(
        "project", F.lower("path").alias("rel"), F.lower("content").alias("text")
    )
    return lowered.groupBy("project").agg(*[F.expr(f"bool_or({flags[n]})").alias(n) for n in SIGNALS])


def samples(files: DataFrame) -> DataFrame:
    """(project, kind, rank, value): routes, messages and interface texts a project shows.

    At most twenty per file count.  Values are made distinct before they are ranked, and the
    rank filter limits groups before the shuffle; the order is that of the text.
    """
    def found(kind: str, pattern: str, exts: list[str] | None = None) -> Column:
        values = F.slice(F.regexp_extract_all("content", F.lit(dialect(pattern)), 1), 1, PER_FILE)
        if exts:
            values = F.when(F.col("ext").isin(*exts), values).otherwise(F.array().cast("array<string>"))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    every = F.concat(
        found("page_routes", ROUTES), found("error_messages", MESSAGES),
        found("ui_text_samples", UI_TEXT, TEXT_EXTS),
    )
    values = _signal_files(files).select("project", F.explode(every).alias("s"))
    w = Window.partitionBy("project", "kind").orderBy("value")
    cap = F.lit(0)
    for kind, n in SAMPLE_CAPS.items():
        cap = F.when(F.col("kind") == kind, n).otherwise(cap)
    return (
        values.select("project", "s.kind", "s.value").distinct()
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= max(SAMPLE_CAPS.values()))
        .where(F.col("rank") <= cap)
    )


def project_profile(files: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals with the application type and the readme text."""
    readme = readmes(files).select("project", F.col("content").alias("readme_content"))
    return (
        signals.join(readme, "project", "left")
        .withColumn("readme_content", F.coalesce("readme_content", F.lit("")))
        .withColumn("app_type", app_type())
    )


def app_type() -> Column:
    has = F.col
    return (
        F.when(has("has_api_docs") & ~has("has_forms"), "developer-tool")
        .when(has("has_admin") & has("has_roles") & has("has_dashboard"), "b2b")
        .when(has("has_payments") | has("has_file_upload") | has("has_video_audio"), "consumer")
        .when(has("has_dashboard") & has("has_data_tables"), "b2b")
        .otherwise("consumer")
    )


def _persona(key: str) -> Column:
    name, role, level, devices = PERSONAS[key]
    description, goals, pains = STORIES[key]
    lists = {"devices": devices, "key_flows": FLOWS[key], "goals": goals, "pain_points": pains}
    return F.struct(
        F.lit(name).alias("name"), F.lit(role).alias("role"), F.lit(level).alias("tech_level"), F.lit(description).alias("description"),
        *[F.array(*[F.lit(x) for x in values]).alias(column) for column, values in lists.items()],
    )


def personas(signals: DataFrame, name_filter: str | None = None, *keep: str) -> DataFrame:
    """(project, pos, name, role, tech_level, description, devices, key_flows, goals, pain_points): up to four per project.

    A filter keeps the names that contain it; a project without such a name keeps all.  ``keep`` names columns of
    ``signals`` to carry along: Spark takes the personas for no larger than the flags they come from, so a join with
    them would be broadcast.
    """
    has = F.col
    primary = (
        F.when(has("has_video_audio") | has("has_file_upload"), _persona("creator"))
        .when(has("has_dashboard") & has("has_data_tables"), _persona("business"))
        .when(has("has_api_docs"), _persona("developer"))
        .otherwise(_persona("user"))
    )
    people = F.array_compact(
        F.array(
            primary,
            F.when(has("has_admin") | has("has_roles"), _persona("admin")),
            _persona("visitor"),
            F.when(has("has_mobile_meta") | has("has_responsive_css"), _persona("mobile")),
        )
    )
    if name_filter:
        wanted = F.filter(people, lambda p: F.lower(p["name"]).contains(name_filter.lower()))
        people = F.when(F.size(wanted) > 0, wanted).otherwise(people)
    return signals.select("project", F.posexplode(people).alias("pos", "p"), *keep).select("project", "pos", "p.*", *keep)


def audiences(people: DataFrame) -> DataFrame:
    """(project, audience, persona): which personas each kind of check applies to."""
    kinds = F.array_compact(
        F.array(
            F.when(F.col("tech_level") == "non-technical", "non-technical"),
            F.when(F.array_contains("devices", "mobile"), "mobile"),
            F.when(F.col("tech_level") == "developer", "developer"),
            F.when(F.lower("name").isin("administrator", "admin"), "admin"),
        )
    )
    return people.select(
        "project", F.explode(kinds).alias("audience"), F.col("name").alias("persona"), "pos"
    )


def _rule(rule_id, severity, confidence, title, why, remedy) -> Rule:
    return Rule(rule_id, severity, "ai_pattern", confidence, "persona", title, why, remedy)


def _first_hover() -> str:
    """First line with a hover style and no touch style near the first place that text occurs."""
    start = f"greatest(instr(content, l) - 1 - {HOVER_SPAN}, 0)"
    near = f"substring(content, {start} + 1, instr(content, l) - 1 + {HOVER_SPAN} - {start})"
    test = both("contains(l, ':hover')", "NOT contains(l, '@media')", f"NOT {has(near, *TOUCH)}")
    numbered = f"transform(split(content, '\\n', -1), (l, i) -> CASE WHEN {test} THEN i + 1 END)"
    return f"try_element_at(array_compact({numbered}), 1)"


def _outside(dirs: list[str]) -> str:
    return f"NOT arrays_overlap(split(path, '/'), array({', '.join(text(d) for d in dirs)}))"


def with_file_facts(files: DataFrame) -> DataFrame:
    """Which checks a file takes part in, and what is missing in it as a whole."""
    component = both(isin("ext", COMPONENT_EXTS), _outside(SKIP_CODE))
    no_loading = both(
        component, match("content", FETCHES, hints=["useQuery", "useSWR", "fetch", "axios."]),
        f"NOT {match('content', LOADING, ignore_case=True)}",
    )
    no_empty = both(
        component, match("content", RENDERS, hints=[".map"]),
        f"NOT {match('content', EMPTY, ignore_case=True)}",
    )
    style = both("ext = '.css'", _outside(SKIP_STYLE), "contains(content, ':hover')")
    facts = {
        "is_ui": both(isin("ext", UI_EXTS), _outside(SKIP)),
        "is_code": both(isin("ext", CODE_EXTS), _outside(SKIP_CODE)),
        "hover_line": f"CASE WHEN {style} THEN {_first_hover()} END",
        "no_loading": no_loading,
        "no_empty": no_empty,
    }
    return files.select("*", *[F.expr(sql).alias(name) for name, sql in facts.items()])


FACTS = ["is_ui", "is_code", "hover_line", "no_loading", "no_empty"]


def persona_detectors() -> list[tuple[str | None, Detector]]:
    """(audience, detector) of the checks on files; no audience means they hold for everyone."""
    unfriendly = both(
        "is_code", has("line", "err", "throw", "raise"),
        either(match("line", p) for p, _ in UNFRIENDLY), f"NOT {match('line', COMMENTED)}",
    )
    return [
        ("non-technical", Detector(
            _rule("ui-jargon", "major", 0.7, "Technical jargon in UI", "The reader will not know the term.",
                  "Say what it means for the user."),
            both("is_ui", match("line", JARGON, hints=[">"])),
            title=f"concat('Technical jargon in UI: \\'', {group('line', JARGON)}, '\\'')",
            with_evidence=False,
        )),
        ("non-technical", Detector(
            _rule("raw-error-code", "major", 0.7, "Raw error code shown to user", "A code does not tell what to do.",
                  "Show a sentence and a way to retry."),
            both("is_ui", match("line", ERROR_CODE, ignore_case=True, hints=[">"])),
            with_evidence=False,
        )),
        ("mobile", Detector(
            _rule("hover-only-interaction", "minor", 0.5, "Hover-only interaction (no touch equivalent)",
                  "Touch screens have no hover.", "Style focus and active states too."),
            "line_no = hover_line",
            with_evidence=False,
        )),
        (None, Detector(
            _rule("unfriendly-error", "minor", 0.6, UNFRIENDLY[0][1], "The message is meant for developers.",
                  "Catch the error and explain it."),
            unfriendly,
            title=case(*[(match("line", p), text(title)) for p, title in UNFRIENDLY]),
            with_evidence=False,
        )),
        (None, Detector(
            _rule("missing-loading-state", "major", 0.7, "Data fetching without loading indicator",
                  "The page looks broken until the data is there.", "Show that it is loading."),
            "no_loading AND line_no = 1", with_evidence=False, file_level=True,
        )),
        (None, Detector(
            _rule("missing-empty-state", "minor", 0.6, "List rendering without empty state",
                  "Nothing is shown when there is no data.", "Say that the list is empty."),
            "no_empty AND line_no = 1", with_evidence=False, file_level=True,
        )),
    ]


VIEWPORT = _rule("missing-viewport", "major", 0.9, "No viewport meta tag for mobile",
                 "The page does not scale on small screens.", "Add a viewport meta tag.")
API_DOCS = _rule("missing-api-docs", "major", 0.8, "API routes exist but no API documentation",
                 "There are routes but no description of them.", "Publish an OpenAPI description.")
EXPORT = _rule("missing-export", "minor", 0.6, "No data export functionality",
               "Administrators need data for reports.", "Offer an export.")
LARGE = _rule("large-asset-mobile", "major", 0.85, "Large asset hurts mobile loading",
              "It takes long on a mobile network.", "Shrink it or load it later.")

PROJECT_RULES = [("mobile", VIEWPORT), ("developer", API_DOCS), ("admin", EXPORT)]


def _project_checks(files: DataFrame, signals: DataFrame) -> DataFrame:
    """(project, det): viewport, API documentation and export, from booleans per project."""
    path, content = F.col("path"), F.col("content")
    rel = F.lower(path)
    page = (F.col("ext") == ".html") | file_name(path).isin("index.tsx", "layout.tsx")
    shown = page & ~has_part(path, SKIP_STYLE)
    docs = ~has_part(path, SKIP_DOCS)
    viewport = content.contains("viewport") & content.contains("width=device-width")
    flags = files.groupBy("project").agg(
        F.bool_or(page).alias("pages"),
        F.bool_or(shown & viewport).alias("viewport"),
        F.bool_or(docs & rel.contains("api/") & F.col("ext").isin(*ROUTE_EXTS)).alias("routes"),
        F.bool_or(docs & contains_any(rel, DOC_WORDS)).alias("docs"),
    )
    j = flags.join(signals.select("project", "has_export"), "project", "left")
    hits = F.array_compact(
        F.array(
            F.when(F.col("pages") & ~F.col("viewport"), "mobile"),
            F.when(F.col("routes") & ~F.col("docs"), "developer"),
            F.when(~F.coalesce("has_export", F.lit(False)), "admin"),
        )
    )
    return j.select("project", F.explode(hits).alias("audience"))


def persona_findings(
    files: DataFrame, signals: DataFrame, people: DataFrame, assets: DataFrame | None = None
) -> DataFrame:
    """Findings with the persona they concern (null: everyone).

    No dedupe: two personas of one kind give two copies of a finding.  The personas are at
    most four rows per project, joined on (project, audience).
    """
    who = audiences(people)
    pairs = persona_detectors()
    detectors = [d for _, d in pairs]
    hits = line_hits(with_file_facts(files), detectors, *FACTS).drop(*FACTS)
    audience = F.element_at(F.array(*[F.lit(a or "") for a, _ in pairs]), F.col("det") + 1)
    # findings for everyone only pass through the join and must not share a key in it
    told = hits.withColumn("audience", audience)
    told = told.withColumn("_who", join_key("project", F.col("audience") != "", "path", "line_no", "det"))
    people_of = who.withColumnsRenamed({"project": "_project", "audience": "_audience"})
    on = (F.col("_who") == F.col("_project")) & (F.col("audience") == F.col("_audience"))
    j = (
        told.join(people_of, on, "left").drop("_who", "_project", "_audience")
        .where((F.col("audience") == "") | F.col("persona").isNotNull())
    )
    parts = [describe(j, detectors, "persona")]
    order = {kind: i for i, (kind, _) in enumerate(PROJECT_RULES)}
    checks = _project_checks(files, signals).join(who, ["project", "audience"])
    det = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("audience"))
    nowhere = F.lit(None).cast("string")
    checks = checks.select(
        "project", nowhere.alias("path"), F.lit(None).cast("int").alias("line_no"),
        nowhere.alias("line"), det.alias("det"), "persona",
    )
    rules = [Detector(r, "true", with_evidence=False) for _, r in PROJECT_RULES]
    parts.append(describe(checks, rules, "persona"))
    if assets is not None:
        large = F.col("size_bytes") > LARGE_MB * MEGABYTE
        big = assets.where(in_asset_dir(F.col("path"), ASSET_DIRS) & large)
        rows = big.join(who.where(F.col("audience") == "mobile"), "project")
        title = F.concat(F.lit("Large asset ("), fixed_point(F.col("size_bytes"), MEGABYTE, 0), F.lit("MB) hurts mobile loading"))
        found = to_findings(rows, LARGE, file=F.col("path"), title=title, evidence=F.col("persona"))
        parts.append(
            found.withColumn("persona", F.col("evidence")).withColumn(
                "evidence", F.lit(None).cast("string")
            )
        )
    return union_all(parts)

