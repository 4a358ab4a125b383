"""Named queries: every operator on tables derived from the given ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievework.operators import findings as fnd
from sievework.operators import deep, external, fixes, history, imports, index, intent, journeys, persona, report, ruletable
from sievework.operators.context import adjust_severity, project_context, project_languages
from sievework.operators.lines import line_findings, line_signals
from sievework.operators.loops import loop_detectors, loop_findings
from sievework.operators.packs import pack_detectors, pack_findings
from sievework.operators.pyfacts import py_facts
from sievework.operators.security import security_detectors, security_findings
from sievework.plans import fixtures as fx
from sievework.plans import oracles as sql
from sievework.functions.skew import numbered, previous_value
from sievework.functions.text import line_count, path_parts
from sievework.schema import severity_rank
from sievework.plans.scan import ScanOptions, deep_scan, incremental_scan, persona_scan, scan
from sievework.sources import files as src
from sievework.sources.rules import BUILT_IN, built_in
from sievework.sources.sinks import LifecycleTable, read_issue_log, read_scans
from sievework.sources.stage import shared_folder, staged
from sievework.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register



# ---- line rules -------------------------------------------------------------------------


@query("security_findings", sql.SECURITY_FINDINGS)
def _(spark, sf):
    return security_findings(fx.code_files(spark, sf)).select(
        "project", "file", "line_no", "rule_id", "severity", "title", "evidence"
    )


@query("comment_state", sql.COMMENT_STATE)
def _(spark, sf):
    return line_signals(fx.code_files(spark, sf), "in_block").select(
        "project", F.col("path").alias("file"), "line_no", "in_block"
    )


@query("js_loop_findings", sql.LOOP_FINDINGS)
def _(spark, sf):
    return loop_findings(fx.code_files(spark, sf)).select(
        "project", "file", "line_no", "rule_id", "severity"
    )


def _pack_query(name: str) -> None:
    @query(f"pack_{name.replace('-', '_')}", sql.pack_findings(name))
    def _(spark, sf):
        return pack_findings(fx.code_files(spark, sf), built_in(name)).select(
            "project", "file", "line_no", "rule_id", "severity", "title", "evidence"
        )


for _name in BUILT_IN:
    _pack_query(_name)


@query("pack_findings", sql.pack_findings(*BUILT_IN))
def _(spark, sf):
    return pack_findings(fx.code_files(spark, sf)).select(
        "project", "file", "line_no", "rule_id", "severity", "title", "evidence"
    )


@query("large_rule_table", sql.LARGE_RULE_TABLE)
def _(spark, sf):
    """Five rules of every document against the lines of all of them."""
    rules = ruletable.rule_table(fx.user_rules(spark, sf))
    return ruletable.table_findings(fx.code_files(spark, sf), rules).select(
        "project", "file", "line_no", "rule_id", "severity", "category", "title", "evidence"
    )


# ---- imports and Python structure -------------------------------------------------------


def _packages(spark, sf):
    return fx.packages(spark, sf).unionByName(src.npm_packages(fx.manifests(spark, sf)))


def _local_modules(spark, sf):
    """Python files plus a local module in some of their directories."""
    extra = fx.table(spark, sf, "documents").where(F.col("doc_id") % 50 == 0).select(
        F.col("source").alias("project"),
        F.concat(F.lit("app/"), "lang", F.lit("/flaskish.py")).alias("path"), F.lit("").alias("content"),
    )
    return fx.py_files(spark, sf).unionByName(src.file_table(extra.distinct()))


@query("import_findings_js", sql.JS_IMPORT_FINDINGS)
def _(spark, sf):
    files = fx.code_files(spark, sf).where("ext <> '.py'")
    none = py_facts(files)
    found = imports.import_findings(files, none, _packages(spark, sf))
    return fnd.dedupe(found).select(
        "project", "file", "line_no", "rule_id", "severity", "title", "evidence"
    )


@query("import_findings_py", sql.PY_IMPORT_FINDINGS)
def _(spark, sf):
    files = fx.py_files(spark, sf)
    found = imports.import_findings(
        files, py_facts(files), _packages(spark, sf), entries_from=_local_modules(spark, sf)
    )
    return fnd.dedupe(found).select("project", "file", "line_no", "title")


@query("ast_findings", sql.AST_FINDINGS)
def _(spark, sf):
    facts = py_facts(fx.py_files(spark, sf))
    return fnd.dedupe(imports.python_findings(facts, None, None)).select(
        "project", "file", "line_no", "end_line", "rule_id", "severity", "title"
    )


# ---- whole scans ------------------------------------------------------------------------

@query("scan_findings", sql.SCAN_FINDINGS)
def _(spark, sf):
    context = project_context(fx.manifests(spark, sf))
    options = ScanOptions(strictness="high")
    found = scan(fx.scan_files(spark, sf), _packages(spark, sf), options, context)
    return found.select(
        "project", "file", "line_no", "rule_id", "severity", "category", "title", "evidence"
    )


@query("scan_low_strictness", sql.SCAN_LOW)
def _(spark, sf):
    context = project_context(fx.manifests(spark, sf))
    options = ScanOptions(strictness="low", rules=[])
    found = scan(fx.scan_files(spark, sf), _packages(spark, sf), options, context)
    return found.select("project", "file", "line_no", "rule_id", "severity")


@query("adjusted_findings", sql.ADJUSTED)
def _(spark, sf):
    context = project_context(fx.manifests(spark, sf))
    return adjust_severity(security_findings(fx.code_files(spark, sf)), context).select(
        "project", "file", "line_no", "rule_id", "severity"
    )


@query("project_context", sql.PROJECT_CONTEXT)
def _(spark, sf):
    return project_context(fx.manifests(spark, sf)).drop("is_library").withColumns(
        {"frameworks": F.array_join("frameworks", ","), "config_files": F.array_join("config_files", ",")}
    )


def _line_rules(spark, sf):
    """Security, loop and pack findings of one pass."""
    detectors = [*security_detectors(), *loop_detectors(), *pack_detectors()]
    return line_findings(fx.code_files(spark, sf), detectors)


@query("scan_summary", sql.SCAN_SUMMARY)
def _(spark, sf):
    s = fnd.summary(_line_rules(spark, sf))
    return s.withColumn("engines_run", F.array_join("engines_run", ",")).withColumn(
        "gate", fnd.findings_gate(F.col("critical"), F.col("major"))
    )


@query("top_rules", sql.TOP_RULES)
def _(spark, sf):
    return (
        security_findings(fx.code_files(spark, sf)).groupBy("rule_id", "severity")
        .agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("file").alias("files"))
    )


# ---- file sources -----------------------------------------------------------------------


@query("file_filter", sql.FILE_FILTER)
def _(spark, sf):
    return src.source_files(fx.code_files(spark, sf), ["src/fr/", "*7.js"]).select(
        "project", "path", "ext", "language", line_count(F.col("content")).cast("long").alias("lines"), "size_bytes", "md5"
    )


@query("incremental_files", sql.INCREMENTAL)
def _(spark, sf):
    return src.changed_since(fx.text_files(spark, sf), fx.scan_state(spark, sf)).select("project", "path")


@query("unchanged_files", sql.UNCHANGED)
def _(spark, sf):
    return src.unchanged(fx.text_files(spark, sf), fx.scan_state(spark, sf)).select("project", "path")


@query("next_state", sql.NEXT_STATE)
def _(spark, sf):
    return src.next_state(fx.text_files(spark, sf), fx.scan_state(spark, sf))


@query("name_status", sql.CHANGES)
def _(spark, sf):
    return src.parse_name_status(fx.changes(spark, sf))


@query("changed_files", sql.CHANGED)
def _(spark, sf):
    changed = src.parse_name_status(fx.changes(spark, sf))
    return src.changed_files(fx.code_files(spark, sf), changed).select("project", "path")


@query("config_files", sql.CONFIG_FILES)
def _(spark, sf):
    return src.config_files(fx.manifests(spark, sf))


@query("readmes", sql.READMES)
def _(spark, sf):
    return src.readmes(fx.manifests(spark, sf))


@query("npm_packages", sql.NPM_PACKAGES)
def _(spark, sf):
    return src.npm_packages(fx.manifests(spark, sf).unionByName(fx.module_files(spark, sf)))


@query("installed_packages", sql.PYPI_PACKAGES)
def _(spark, sf):
    return src.installed_packages(fx.package_listing(spark, sf))


@query("reject_counts", sql.REJECT_COUNTS)
def _(spark, sf):
    raw = src.judged(fx.raw_files(spark, sf), ["skip/me/"], fx.LEAST_LARGE)
    return src.reject_counts(src.rejected(raw))


@query("python_rejects", sql.UNPARSED)
def _(spark, sf):
    files = fx.py_files(spark, sf)
    raw = src.judged(files.select("project", "path", F.col("content").cast("binary").alias("content"), "size_bytes"))
    return src.rejected(raw, py_facts(files))


# ---- history and dismissals -------------------------------------------------------------


def _log(spark, sf):
    log = fx.issue_log(spark, sf)
    return log.withColumn(
        "fingerprint", history.fingerprint(F.col("rule_id"), F.col("file"), F.col("line"))
    )


@query("issue_log", sql.ISSUE_LOG)
def _(spark, sf):
    return _log(spark, sf).select("seq", "project", "scan_id", "fingerprint")


@query("scans", sql.SCANS)
def _(spark, sf):
    return history.scan_rows(_log(spark, sf))


@query("scan_history", sql.SCAN_HISTORY)
def _(spark, sf):
    return history.scan_history(history.scan_rows(_log(spark, sf)))


@query("previous_scans", sql.PREVIOUS_SCANS)
def _(spark, sf):
    ids = history.scan_rows(_log(spark, sf)).select("project", "scan_id")
    return previous_value(ids, ["project"], "scan_id", "prev_id", width=8)


@query("quality_delta", sql.DELTA)
def _(spark, sf):
    log = _log(spark, sf)
    return history.quality_delta(history.scan_rows(log), log)


@query("lifecycle", sql.LIFECYCLE)
def _(spark, sf):
    log = _log(spark, sf)
    return history.lifecycle(history.scan_rows(log), log)


@query("quality_delta_by_print", sql.DELTA)
def _(spark, sf):
    log = _log(spark, sf)
    return history.quality_delta_by_print(history.scan_rows(log), log)


@query("lifecycle_by_print", sql.LIFECYCLE)
def _(spark, sf):
    log = _log(spark, sf)
    return history.lifecycle_by_print(history.scan_rows(log), log)


@query("lifecycle_kept", sql.LIFECYCLE)
def _(spark, sf):
    """The scans of the log taken in one after the other."""
    log = staged(_log(spark, sf).withColumn("scan_mode", F.lit("full")))
    scans = staged(previous_value(history.scan_rows(log).select("project", "scan_mode", "scan_id"), ["project", "scan_mode"], "scan_id", "prev_id"))
    kept = LifecycleTable(spark, shared_folder(spark, "lifecycle"), buckets=8)
    for step, row in enumerate(scans.select("scan_id").distinct().orderBy("scan_id").collect()):  # one number per scan
        of_scan = F.col("scan_id") == row.scan_id
        kept.update(step, log.where(of_scan), scans.where(of_scan))
    return kept.statuses().drop("scan_mode")


@query("carry_forward", sql.CARRY_FORWARD)
def _(spark, sf):
    """Every scan takes over the last one's rows of its unchanged files: here scan n is read as scan n + 1."""
    log = _log(spark, sf)
    per_scan = F.concat("project", F.lit("@"), F.col("scan_id").cast("string"))
    now = log.withColumn("project", per_scan).select("project", "rule_id", "file", "line", "severity")
    before = log.withColumn("project", F.concat("project", F.lit("@"), (F.col("scan_id") + 1).cast("string")))
    skipped = before.where("file LIKE '%.py'").select("project", F.col("file").alias("path"))
    return history.carry_forward(now, before, skipped)


@query("incremental_delta", sql.INCREMENTAL_DELTA)
def _(spark, sf):
    """Four incremental scans of a tree that changes; the last one against the one before."""
    root = shared_folder(spark, "history")
    context, packages = staged(project_context(fx.manifests(spark, sf))), staged(_packages(spark, sf))
    for step in range(4):
        incremental_scan(fx.tree_at(spark, sf, step), packages, root, step, ScanOptions(strictness="high"), context=context)
    return history.quality_delta(read_scans(spark, root), read_issue_log(spark, root)).drop("scan_mode")


@query("dismissal_state", sql.DISMISSALS)
def _(spark, sf):
    return history.dismissal_state(fx.dismissal_events(spark, sf))


@query("dismissal_state_cleared", sql.DISMISSALS_CLEARED)
def _(spark, sf):
    return history.dismissal_state(fx.dismissal_events(spark, sf), fx.dismissal_clears(spark, sf))


@query("dismissals_by_count", sql.DISMISSALS_PLACED)
def _(spark, sf):
    """The list in its order, each project's part numbered along it."""
    listed = history.dismissals(history.dismissal_state(fx.dismissal_events(spark, sf)))
    along = Window.partitionBy("project").orderBy("at")
    placed = listed.withColumn("at", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(along).cast("long"))
    return placed.drop("at")


@query("unsuppressed_findings", sql.UNSUPPRESSED)
def _(spark, sf):
    state = history.dismissal_state(fx.dismissal_events(spark, sf))
    return history.unsuppressed(fx.issue_log(spark, sf), state).select(
        "seq", "project", "rule_id", "file", "line"
    )


# ---- project index ----------------------------------------------------------------------


@query("file_index", sql.FILE_INDEX)
def _(spark, sf):
    ix = index.file_index(fx.code_files(spark, sf))
    lists = ["imports", "functions", "classes", "global_state_lines"]
    return ix.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in lists}).withColumn(
        "line_count", F.col("line_count").cast("long")
    )


@query("project_totals", sql.PROJECT_TOTALS)
def _(spark, sf):
    totals = index.project_totals(index.file_index(fx.code_files(spark, sf)))
    return totals.withColumn("languages", F.array_join("languages", ","))


@query("import_edges", sql.IMPORT_EDGES)
def _(spark, sf):
    files = fx.linked_files(spark, sf)
    return index.import_edges(index.file_index(files), files)


@query("top_files", sql.TOP_FILES)
def _(spark, sf):
    files = fx.linked_files(spark, sf)
    ix = staged(index.file_index(files))
    return index.top_files(ix, index.import_edges(ix, files)).select(
        "project", "path", "rank", "in_degree", "score"
    )


@query("architecture_summary", sql.ARCHITECTURE)
def _(spark, sf):
    context = project_context(fx.manifests(spark, sf))
    return index.architecture_summary(staged(index.file_index(fx.code_files(spark, sf))), context)


@query("directory_summary", sql.DIRECTORY_SUMMARY)
def _(spark, sf):
    return index.directory_summary(fx.code_files(spark, sf)).withColumn("chunk", F.md5("chunk"))


@query("context_pack", sql.CONTEXT_PACK)
def _(spark, sf):
    files = fx.project_files(spark, sf)
    ix = staged(index.file_index(files))
    edges = index.import_edges(ix, files)
    context = project_context(fx.manifests(spark, sf))
    return index.context_pack(files, ix, edges, context).withColumn("text", F.md5("text"))


# ---- deep checks ------------------------------------------------------------------------

_DEEP = ["project", "file", "line_no", "rule_id", "severity", "title"]


def _deep_query(rule_id: str) -> None:
    @query("deep_" + rule_id.replace("-", "_"), sql.deep_rule(rule_id))
    def _(spark, sf):
        files = fx.project_files(spark, sf)
        context = project_context(fx.manifests(spark, sf))
        if rule_id == "missing-cache-headers":
            return deep.uncached_assets(fx.assets(spark, sf), fx.manifests(spark, sf)).select(*_DEEP)
        found = deep.code_checks(files, context, only=(rule_id,))
        if rule_id == "cors-wildcard-api":
            found = fnd.dedupe(found.unionByName(deep.config_cors(files, context)), (rule_id,))
        return found.select(*_DEEP)


for _name in [*sql.DEEP_RULES, "missing-cache-headers"]:
    _deep_query(_name)


@query("deep_findings", sql.DEEP_FINDINGS)
def _(spark, sf):
    files = fx.project_files(spark, sf)
    context = project_context(fx.manifests(spark, sf))
    return deep.deep_findings(files, context, fx.assets(spark, sf)).select(*_DEEP)


@query("deep_scan", sql.DEEP_SCAN)
def _(spark, sf):
    return deep_scan(fx.project_files(spark, sf), fx.assets(spark, sf)).select(*_DEEP)


@query("deep_in_order", sql.DEEP_ORDERED)
def _(spark, sf):
    """Every deep finding with its place in its project's list, a project being split by severity and folder."""
    files = fx.project_files(spark, sf)
    found = deep.deep_findings(files, project_context(fx.manifests(spark, sf)), fx.assets(spark, sf))
    folder = F.struct(severity_rank("severity"), F.slice(path_parts(F.coalesce("file", F.lit(""))), 1, 3))
    placed = numbered(found, ["project"], folder, fnd.report_order(), "place")
    return placed.select("project", "file", "line_no", "rule_id", F.col("place").cast("long").alias("place"))


# ---- personas ---------------------------------------------------------------------------


def _persona_files(spark, sf):
    return fx.project_files(spark, sf).unionByName(fx.style_files(spark, sf))


@query("persona_signals", sql.PERSONA_SIGNALS)
def _(spark, sf):
    files = _persona_files(spark, sf)
    return persona.project_profile(files, persona.project_signals(files))


@query("personas", sql.PERSONAS)
def _(spark, sf):
    signals = fx.features(spark, sf)
    # flags and types meet before the long texts are there, sorted on disk: both grow with the projects
    types = signals.select("project", persona.app_type().alias("app_type"))
    people = persona.personas(signals.hint("merge").join(types, "project"), None, "app_type")
    lists = ["devices", "key_flows", "goals", "pain_points"]
    return people.withColumns({c: F.array_join(c, "|") for c in lists})


@query("personas_by_name", sql.PERSONAS_FILTERED)
def _(spark, sf):
    return persona.personas(fx.features(spark, sf), "Admin").select("project", "name")


@query("persona_samples", sql.SAMPLES)
def _(spark, sf):
    return persona.samples(fx.sample_files(spark, sf))


def _persona_findings(spark, sf):
    signals = fx.features(spark, sf, customers=False)
    return persona.persona_findings(
        _persona_files(spark, sf), signals, persona.personas(signals), fx.assets(spark, sf)
    ).select(*_DEEP, "persona")


@query("persona_findings", sql.PERSONA_FINDINGS)
def _(spark, sf):
    return _persona_findings(spark, sf)


def _persona_query(rule_id: str) -> None:
    @query("persona_" + rule_id.replace("-", "_"), sql.persona_rule(rule_id))
    def _(spark, sf):
        return _persona_findings(spark, sf).where(F.col("rule_id") == rule_id)


for _name in sql.PERSONA_RULES:
    _persona_query(_name)


@query("persona_scan", sql.PERSONA_SCAN)
def _(spark, sf):
    return persona_scan(_persona_files(spark, sf), fx.assets(spark, sf)).select(*_DEEP, "persona")


# ---- intent and reviews from elsewhere ---------------------------------------------------


@query("fidelity", sql.FIDELITY)
def _(spark, sf):
    score = intent.fidelity(intent.assertion_results(*fx.assertion_rows(spark, sf)))
    return score.select(
        "intent_id", "results", F.col("fidelity_raw").alias("fidelity"),
        fnd.score_gate(F.col("fidelity_raw"), fnd.FIDELITY_LIMITS).alias("gate"),
    )


@query("intent_findings", sql.INTENT_FINDINGS)
def _(spark, sf):
    results = intent.assertion_results(*fx.assertion_rows(spark, sf))
    return intent.intent_findings(results, "intent_id").select(
        "project", "file", "rule_id", "severity", "title", "description", "intent_id", "seq"
    )


@query("best_intent", sql.BEST_INTENT)
def _(spark, sf):
    return intent.best_intent(fx.intents(spark, sf))


_REVIEW = ["project", "file", "line_no", "severity", "category", "title", "confidence", "rule_id", "seq"]


@query("file_reviews", sql.FILE_REVIEWS)
def _(spark, sf):
    return external.file_reviews(fx.review_payloads(spark, sf, False)).select(*_REVIEW)


@query("project_reviews", sql.PROJECT_REVIEWS)
def _(spark, sf):
    return external.project_reviews(fx.review_payloads(spark, sf, True)).select(*_REVIEW)


@query("assertions", sql.ASSERTIONS)
def _(spark, sf):
    return external.assertions(fx.assertion_payloads(spark, sf))


@query("step_evaluations", sql.STEP_EVALUATIONS)
def _(spark, sf):
    return external.step_evaluations(fx.step_payloads(spark, sf)).drop("reasoning")


# ---- journeys ---------------------------------------------------------------------------


def _steps(spark, sf):
    """Journey steps numbered in time; a journey is split by the hour for numbering."""
    return numbered(
        fx.journey_events(spark, sf), ["journey_id"], F.date_trunc("hour", "ts"),
        [F.col("ts"), F.col("event_id")], "step_num",
    )


@query("step_numbers", sql.STEP_NUMBERS)
def _(spark, sf):
    return _steps(spark, sf).select("event_id", "journey_id", "step_num")


@query("journey_scores", sql.JOURNEY_SCORES)
def _(spark, sf):
    return journeys.journey_scores(fx.journey_events(spark, sf))


@query("worst_journey", sql.WORST)
def _(spark, sf):
    scores = journeys.journey_scores(fx.journey_events(spark, sf))
    user = F.split_part("journey_id", F.lit("-"), F.lit(1))
    return journeys.worst_journey(scores.withColumn("user_key", user), "user_key")


@query("step_history", sql.STEP_HISTORY)
def _(spark, sf):
    return journeys.step_history(_steps(spark, sf)).select(
        "journey_id", "step_num", F.array_join("history", " ").alias("history")
    )


@query("top_frictions", sql.TOP_FRICTIONS)
def _(spark, sf):
    return journeys.top_frictions(_steps(spark, sf))


# ---- fixes ------------------------------------------------------------------------------


@query("fix_windows", sql.FIX_WINDOWS)
def _(spark, sf):
    files = fx.code_files(spark, sf)
    return fixes.fix_windows(security_findings(files), files)


def _usable(spark, sf):
    files = fx.code_files(spark, sf)
    found = staged(security_findings(files))
    return files, fixes.usable_fixes(fx.proposed_fixes(found), found, files)


@query("usable_fixes", sql.USABLE_FIXES)
def _(spark, sf):
    return _usable(spark, sf)[1].select(
        "project", "path", "line_no", "rule_id", F.round("confidence", 6).alias("confidence"), "severity", "title"
    )


@query("applied_fixes", sql.APPLIED_FIXES)
def _(spark, sf):
    return fixes.apply_fixes(*_usable(spark, sf)).withColumn("content", F.md5("content"))


# ---- reports ----------------------------------------------------------------------------


@query("report_json", sql.REPORT_JSON)
def _(spark, sf):
    records = report.json_records(staged(security_findings(fx.code_files(spark, sf))))
    fields = {
        "rule_id": "$.rule_id", "file": "$.location.file", "line": "$.location.line", "total": "$.summary.total_issues",
    }
    return records.select("project", "record", *[F.get_json_object("body", p).alias(n) for n, p in fields.items()])


def _checked_intent(spark, sf):
    """Assertions and their score by project, for the report."""
    rows = intent.assertion_results(*fx.assertion_rows(spark, sf))
    scores = intent.fidelity(rows.withColumn("intent_id", F.col("project"))).select(
        F.col("intent_id").alias("project"), F.concat(F.lit("keep "), "intent_id").alias("raw_intent"), "fidelity_score"
    )
    return rows.withColumn("idx", F.col("intent_id") * 100 + F.col("idx")), scores


@query("report_json_full", sql.REPORT_JSON_FULL)
def _(spark, sf):
    """Every record with its whole body."""
    found = staged(security_findings(fx.code_files(spark, sf)))
    results, scores = _checked_intent(spark, sf)
    records = report.json_records(
        found, F.concat(F.lit("checkouts/"), "project"), "2024-05-06T07:08:09Z", 1234, scores=scores, results=results
    )
    return records.select("project", "record", "body")


@query("report_markdown_full", sql.REPORT_MARKDOWN_FULL)
def _(spark, sf):
    """With target, date, duration, score and intent."""
    found = staged(security_findings(fx.code_files(spark, sf)))
    results, scores = _checked_intent(spark, sf)
    lines = report.markdown(
        found, results, scores, timestamp="2024-05-06", duration_ms=1234, target=F.concat(F.lit("checkouts/"), "project")
    )
    return lines.select("project", "section", "rank", "line_key", "text")


@query("report_markdown", sql.REPORT_MARKDOWN)
def _(spark, sf):
    return report.markdown(staged(security_findings(fx.code_files(spark, sf)))).select("project", "section", "rank", "text")


# ---- streams ----------------------------------------------------------------------------


def _stream_root(spark: SparkSession) -> str:
    return shared_folder(spark, "streams")


def _finish(started: StreamingQuery) -> None:
    started.awaitTermination()


@query("stream_scan", sql.at_step(sql.SCAN_FINDINGS, 3))
def _(spark, sf):
    """Four steps of the tree, a micro-batch each: files change, change back, move and go."""
    root = _stream_root(spark)
    context = project_context(fx.manifests(spark, sf))
    packages, options = _packages(spark, sf), ScanOptions(strictness="high")
    for step in range(4):
        arrived = fx.versions_at(spark, sf, step)
        arrived.write.mode("append").parquet(f"{root}/in")
        versions = spark.readStream.schema(arrived.schema).parquet(f"{root}/in")
        _finish(jobs.scan_stream(versions, packages, context, root, f"{root}/checkpoint", options))
    return jobs.current_findings(spark, root, 4).select(
        "project", "file", "line_no", "rule_id", "severity", "category", "title", "evidence"
    )


@query("stream_dismissal_counts", sql.STREAM_DISMISSALS)
def _(spark, sf):
    root = _stream_root(spark)
    counts = jobs.dismissal_counts(fx.dismissal_events(spark, sf, fx.stream(spark, sf, "events")))
    _finish(jobs.run(counts, "", f"{root}/checkpoint", "update", jobs.keep_latest(f"{root}/counts")))
    return jobs.read_latest(spark, f"{root}/counts", "project", "rule_id", "file_pattern")


@query("stream_dismissals_cleared", sql.DISMISSALS_CLEARED)
def _(spark, sf):
    """Dismissals and clears in three micro-batches, out of their order."""
    root = _stream_root(spark)
    events = fx.dismissal_events(spark, sf).withColumn("clear", F.lit(False))
    clears = fx.dismissal_clears(spark, sf).withColumns({"ts": F.lit(None).cast("timestamp_ntz"), "reason": F.lit(None).cast("string")})
    rows = events.unionByName(clears.withColumn("clear", F.lit(True)))
    for step in (1, 2, 0):
        rows.where(F.col("seq") % 3 == step).write.mode("append").parquet(f"{root}/in")
        arrived = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        _finish(jobs.dismissal_stream(arrived, root, f"{root}/checkpoint"))
    counts = jobs.DismissalState(spark, root).counts.before(3)
    return counts.withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


@query("stream_issue_rate", sql.STREAM_RATE)
def _(spark, sf):
    root = _stream_root(spark)
    rate = jobs.issue_rate(fx.issue_log(spark, sf, fx.stream(spark, sf, "events")))
    _finish(jobs.run(rate, f"{root}/rate", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/rate")


@query("stream_journeys", sql.STREAM_JOURNEYS)
def _(spark, sf):
    root = _stream_root(spark)
    sessions = jobs.journey_sessions(fx.journey_events(spark, sf, fx.stream(spark, sf, "events")))
    _finish(jobs.run(sessions, f"{root}/sessions", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/sessions")


@query("stream_gate_alerts", sql.STREAM_GATES)
def _(spark, sf):
    root = _stream_root(spark)
    issues = fx.issue_log(spark, sf, fx.stream(spark, sf, "events")).withColumn("engine", F.lit("code"))
    _finish(jobs.run(jobs.gate_counts(issues), "", f"{root}/checkpoint", "update", jobs.keep_latest(f"{root}/counts")))
    return jobs.gate_alerts(spark, f"{root}/counts")


# ---- further faces of the same operators -------------------------------------------------


@query("scan_change_set", sql.SCAN_CHANGE_SET)
def _(spark, sf):
    changed = src.parse_name_status(fx.changes(spark, sf))
    found = scan(
        fx.code_files(spark, sf), _packages(spark, sf), ScanOptions(strictness="high"),
        project_context(fx.manifests(spark, sf)), changes=changed,
    )
    return found.select("project", "file", "line_no", "rule_id", "severity")


@query("project_languages", sql.PROJECT_LANGUAGES)
def _(spark, sf):
    return project_languages(fx.code_files(spark, sf)).withColumn("languages", F.array_join("languages", ","))


@query("deep_useeffect_parity", sql.EFFECT_PARITY)
def _(spark, sf):
    files = fx.project_files(spark, sf)
    context = project_context(fx.manifests(spark, sf))
    found = deep.code_checks(files, context, parity=True, only=("useeffect-missing-cleanup",))
    return found.select("project", "file", "line_no")


@query("findings_in_order", sql.ORDERED)
def _(spark, sf):
    """Every finding with its place in its project's report, a project being split by severity and folder."""
    found = security_findings(fx.code_files(spark, sf))
    folder = F.struct(severity_rank("severity"), F.slice(path_parts("file"), 1, 3))
    placed = numbered(found, ["project"], folder, fnd.report_order(), "place")
    return placed.select("project", "file", "line_no", "rule_id", F.col("place").cast("long").alias("place"))
