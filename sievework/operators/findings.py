"""What happens to findings after detection: dedupe, strictness, order, summary, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import path_parts
from sievework.schema import FINDING, SEVERITY_RANK, severity_rank

# Severities per strictness level; gate limits.
STRICTNESS = {
    "low": ["critical"],
    "medium": ["critical", "major"],
    "high": ["critical", "major", "minor", "info"],
}
FIDELITY_LIMITS = (40, 70)
JOURNEY_LIMITS = (30, 60)


def by_strictness(findings: DataFrame, level: str = "medium") -> DataFrame:
    return findings.where(F.col("severity").isin(*STRICTNESS.get(level, STRICTNESS["medium"])))


def dedupe(findings: DataFrame, once_per_project: tuple[str, ...] = ()) -> DataFrame:
    """First finding per (project, file, line, rule), by detector order.

    Rules in ``once_per_project`` keep their first finding of the whole project, in path
    order.  An aggregate rather than a row number, so copies collapse before the shuffle and
    a project of any size sends one such row per task.
    """
    key = ["project", "_file", "_line", "_rule"]
    rest = [c for c in findings.columns if c not in ("project",)]
    file, line = F.coalesce("file", F.lit("")), F.coalesce("line_no", F.lit(0))
    once = F.coalesce(F.col("rule_id").isin(*once_per_project), F.lit(False))
    first = F.struct("ord", path_parts(file), line, "seq", "title")
    return (
        findings.withColumn("_file", F.when(once, "").otherwise(file))
        .withColumn("_line", F.when(once, 0).otherwise(line))
        .withColumn("_rule", F.coalesce("rule_id", "title"))
        .groupBy(*key)
        .agg(F.min_by(F.struct(*rest), first).alias("f"))
        .select("project", "f.*")
        .select(*findings.columns)
    )


def report_order() -> list[Column]:
    """Most severe first, then project, path order, line."""
    return [
        severity_rank("severity"), F.col("project"), path_parts(F.coalesce("file", F.lit(""))),
        F.coalesce("line_no", F.lit(0)), F.col("rule_id"),
    ]


def in_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*report_order())


def summary(findings: DataFrame, *keys: str) -> DataFrame:
    """Counts by severity and the engines that reported, per ``keys`` (default project)."""
    keys = keys or ("project",)
    return findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_issues"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK],
        F.sort_array(F.collect_set("engine")).alias("engines_run"),
    )


def findings_gate(critical: Column, major: Column) -> Column:
    """2 with a critical finding, 1 with a major one, else 0."""
    return F.when(critical > 0, 2).when(major > 0, 1).otherwise(0)


def score_gate(score: Column, limits: tuple[int, int]) -> Column:
    """2 below the first limit, 1 below the second, else 0."""
    return F.when(score < limits[0], 2).when(score < limits[1], 1).otherwise(0)


def finding_id(prefix: str = "f") -> Column:
    """Readable id of a finding."""
    return F.concat_ws(
        "-", F.lit(prefix), "rule_id",
        F.concat_ws(":", F.coalesce("file", F.lit("")), F.coalesce("line_no", F.lit(0)).cast("string")),
    )


def with_location(findings: DataFrame) -> DataFrame:
    """Nested shape: a null location where there is no file; column and function stay null."""
    loc = F.when(
        F.col("file").isNotNull(),
        F.struct(
            F.col("file"), F.col("line_no").alias("line"), "end_line",
            F.lit(None).cast("int").alias("column"), F.lit(None).cast("string").alias("function"),
        ),
    )
    flat = [c for c in FINDING if c not in ("file", "line_no", "end_line", "ord", "seq")]
    return findings.select(finding_id().alias("id"), *flat, loc.alias("location"))
