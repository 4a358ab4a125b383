"""Column names, enumerations and the shape of a finding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severity order, finding categories, assertion types and states.
SEVERITY_RANK = {"critical": 0, "major": 1, "minor": 2, "info": 3}
CATEGORIES = ("security", "performance", "logic", "import", "ai_pattern", "intent", "style")
ASSERTION_TYPES = (
    "dependency", "route", "behavior", "security", "function", "file", "pattern", "ui",
)
ASSERTION_STATES = ("pass", "fail", "partial", "unknown")

FILE = ["project", "path"]

FINDING = [
    "project", "file", "line_no", "end_line", "rule_id", "severity", "category", "title",
    "description", "suggestion", "confidence", "engine", "evidence", "ord", "seq",
]
FINDING_DDL = (
    "project string, file string, line_no int, end_line int, rule_id string, severity string, "
    "category string, title string, description string, suggestion string, confidence double, "
    "engine string, evidence string, ord int, seq bigint"
)


@dataclass(frozen=True)
class Rule:
    """What a detector says about a hit."""

    rule_id: str
    severity: str
    category: str
    confidence: float
    engine: str
    title: str
    why: str = ""
    remedy: str | None = None


def severity_rank(col: Column | str) -> Column:
    """0 (critical) .. 3 (info), 99 for anything else."""
    c = F.col(col) if isinstance(col, str) else col
    out = F.lit(99)
    for name, rank in SEVERITY_RANK.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def to_findings(
    hits: DataFrame,
    rule: Rule,
    *,
    file: Column | None = None,
    line_no: Column | None = None,
    end_line: Column | None = None,
    title: Column | None = None,
    description: Column | None = None,
    evidence: Column | None = None,
    severity: Column | None = None,
    order: int = 0,
    seq: Column | None = None,
) -> DataFrame:
    """Project rows of one detector to the finding columns.

    ``ord`` is the detector's place in its engine and ``seq`` the place inside one line; both
    only decide which of two findings with the same key is kept.
    """
    nothing = F.lit(None)
    return hits.select(
        F.col("project"),
        (nothing.cast("string") if file is None else file).alias("file"),
        (nothing if line_no is None else line_no).cast("int").alias("line_no"),
        (nothing if end_line is None else end_line).cast("int").alias("end_line"),
        F.lit(rule.rule_id).alias("rule_id"),
        (F.lit(rule.severity) if severity is None else severity).alias("severity"),
        F.lit(rule.category).alias("category"),
        (F.lit(rule.title) if title is None else title).alias("title"),
        (F.lit(rule.why) if description is None else description).alias("description"),
        F.lit(rule.remedy).cast("string").alias("suggestion"),
        F.lit(rule.confidence).cast("double").alias("confidence"),
        F.lit(rule.engine).alias("engine"),
        (nothing.cast("string") if evidence is None else evidence).alias("evidence"),
        F.lit(order).alias("ord"),
        (F.lit(0) if seq is None else seq).cast("long").alias("seq"),
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

