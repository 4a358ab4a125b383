"""Reports as datasets: JSON records and Markdown lines.

A report is written as rows in order, never as one string: a project's findings may be more
than one task or one cell should hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.findings import summary, with_location
from sievework.schema import SEVERITY_RANK, severity_rank, union_all

# Marks of the severities and of the assertion states, version of the layout.
MARKS = {"critical": "!!!", "major": "!!", "minor": "!", "info": "i"}
STATE_MARKS = {"pass": "+", "fail": "x", "partial": "~", "unknown": "?"}
VERSION = "1.0.0"
ORDER = ["project", "section", "rank", "file_key", "line_key", "sub"]


def _per_project(df: DataFrame | None, name: str, *columns: str) -> DataFrame | None:
    """(project, name): the other columns of a one-row-per-project table as one struct."""
    if df is None:
        return None
    return df.select("project", F.struct(*(columns or [c for c in df.columns if c != "project"])).alias(name))


def json_records(
    findings: DataFrame, target: Column | None = None, timestamp: str | None = None, duration_ms: int | None = None,
    scores: DataFrame | None = None, results: DataFrame | None = None, architecture: DataFrame | None = None,
    context: DataFrame | None = None,
) -> DataFrame:
    """(project, record, body): one summary record per project, one per finding, one per checked assertion.

    ``timestamp`` (ISO text) and ``duration_ms`` of the scan are known to the caller.  ``scores``: project, raw_intent,
    fidelity_score; ``results`` as for ``markdown``; ``architecture``: project, architecture_summary;
    ``context``: project and whatever ``project_context`` says.  What is not given or null is left out.
    """
    s = summary(findings)
    extra = [
        _per_project(scores, "_score", "raw_intent", "fidelity_score"), _per_project(architecture, "_built", "architecture_summary"),
        _per_project(context, "_context"),
    ]
    for df in extra:
        s = s if df is None else s.join(df, "project", "left")

    def given(column: str, kind: str) -> Column:
        return F.col(column) if column.split(".")[0] in s.columns else F.lit(None).cast(kind)

    counts = F.struct(
        "total_issues", *SEVERITY_RANK, given("_score.fidelity_score", "double").alias("fidelity_score"), "engines_run",
        F.lit(duration_ms).cast("long").alias("scan_duration_ms"),
    )
    head = s.select(
        "project", F.lit("summary").alias("record"),
        F.to_json(
            F.struct(
                F.lit(VERSION).alias("version"), F.lit(timestamp).alias("timestamp"), "project",
                (F.col("project") if target is None else target).alias("target"), given("_score.raw_intent", "string").alias("intent"),
                counts.alias("summary"), given("_built.architecture_summary", "string").alias("architecture_summary"),
                given("_context", "struct<none:string>").alias("project_context"),
            )
        ).alias("body"),
    )
    located = with_location(findings)
    each = located.select(
        "project", F.lit("issue").alias("record"),
        F.to_json(F.struct(*[c for c in located.columns if c != "project"])).alias("body"),
    )
    out = head.unionByName(each)
    if results is not None:
        checked = F.struct("idx", "description", "expect", F.lower("status").alias("status"), "evidence")
        out = out.unionByName(results.select("project", F.lit("intent").alias("record"), F.to_json(checked).alias("body")))
    return out


def _upper(col: str) -> Column:
    return F.upper(F.col(col))


def _rows(df: DataFrame, section: int, text: Column, rank: Column | None = None,
          file: Column | None = None, line: Column | None = None, sub: Column | None = None) -> DataFrame:
    return df.select(
        "project", F.lit(section).alias("section"),
        (F.lit(0) if rank is None else rank).cast("int").alias("rank"),
        (F.lit("") if file is None else file).alias("file_key"),
        (F.lit(0) if line is None else line).cast("long").alias("line_key"),
        (F.lit("") if sub is None else sub).alias("sub"),
        text.alias("text"),
    )


def finding_text() -> Column:
    """The Markdown entry of one finding."""
    place = F.when(
        F.col("file").isNotNull(),
        F.concat(
            F.lit(" `"), "file",
            F.coalesce(F.concat(F.lit(":"), F.nullif("line_no", F.lit(0)).cast("string")), F.lit("")), F.lit("`"),
        ),
    ).otherwise("")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("- **["), _upper("category"), F.lit("]** "), "title", place),
        F.concat(F.lit("  "), "description"),
        F.concat(F.lit("  > Fix: "), F.nullif("suggestion", F.lit(""))),
        F.lit(""),
    )


def markdown(
    findings: DataFrame, results: DataFrame | None = None, scores: DataFrame | None = None,
    heading: str = "Code Report", timestamp: str | None = None, duration_ms: int | None = None, target: Column | None = None,
) -> DataFrame:
    """Rows (project, section, rank, file_key, line_key, sub, text); sorted by these columns the
    texts of a project are its report.

    ``results``: project, idx, description, expect, status, evidence; ``scores``: project,
    raw_intent, fidelity_score.  ``target`` (a column of what was scanned), ``timestamp`` and ``duration_ms`` of the scan
    appear in the head if given.
    """
    s = summary(findings)
    said = [F.concat(F.lit("**Target:** "), target)] if target is not None else []
    said += [F.lit(f"**Date:** {timestamp}")] if timestamp else []
    said += [F.lit(f"**Duration:** {duration_ms}ms")] if duration_ms is not None else []
    table = F.concat_ws(
        "\n",
        F.lit(f"# {heading}"), F.concat(F.lit("**Project:** "), "project"), *said, F.lit(""),
        F.lit("## Summary"), F.lit(""), F.lit("| Severity | Count |"), F.lit("|----------|-------|"),
        *[F.concat(F.lit(f"| {name.capitalize()} | "), F.col(name), F.lit(" |")) for name in SEVERITY_RANK],
        F.concat(F.lit("| **Total** | **"), F.col("total_issues"), F.lit("** |")), F.lit(""),
    )
    parts = [_rows(s, 0, table), _rows(s, 2, F.lit("## Issues\n"))]
    heads = s.select("project", F.explode(F.array(*[
        F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("name"), F.lit(MARKS[name]).alias("mark"), F.col(name).alias("n"))
        for name, rank in SEVERITY_RANK.items()
    ])).alias("h")).select("project", "h.*").where("n > 0")
    title = F.concat(F.lit("### ["), "mark", F.lit("] "), _upper("name"), F.lit(" ("), F.col("n"), F.lit(")\n"))
    parts.append(_rows(heads, 3, title, rank=F.col("rank"), file=F.lit(""), line=F.lit(-1)))
    parts.append(
        _rows(findings, 3, finding_text(), rank=severity_rank("severity"),
              file=F.coalesce("file", F.lit("")), line=F.coalesce("line_no", F.lit(0)),
              sub=F.concat_ws(":", "rule_id", "title"))
    )
    if scores is not None:
        score = F.concat(F.lit("**Prompt Fidelity Score:** "), F.col("fidelity_score").cast("string"), F.lit("/100\n"))
        parts.append(_rows(scores, 1, score))
        head = F.concat(
            F.lit("## Intent Verification\n\n**Intent:** "), F.col("raw_intent"),
            F.lit("\n**Fidelity Score:** "), F.col("fidelity_score").cast("string"), F.lit("/100\n"),
        )
        parts.append(_rows(scores, 4, head))
    if results is not None:
        mark = F.lit("?")
        for name, m in STATE_MARKS.items():
            mark = F.when(F.lower("status") == name, m).otherwise(mark)
        text = F.concat_ws(
            "\n", F.concat(F.lit("- ["), mark, F.lit("] "), F.col("description")),
            F.concat(F.lit("  Expected: "), F.col("expect")),
            F.concat(F.lit("  Found: "), F.nullif("evidence", F.lit(""))), F.lit(""),
        )
        parts.append(_rows(results, 5, text, line=F.col("idx")))
    return union_all(parts)
