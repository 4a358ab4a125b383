"""Stated intent against what was found: assertions, fidelity score, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.schema import ASSERTION_STATES, ASSERTION_TYPES

# Sources of an intent, best first; importance above which a miss is major.
SOURCES = ["cli", "spec_file", "git_commit"]
MAJOR_ABOVE = 0.7


def best_intent(candidates: DataFrame) -> DataFrame:
    """(project, source, text): the best non-empty source of each project, else ('none', '')."""
    text = F.trim("text")
    rank = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    usable = (rank > 0) & (F.coalesce(F.length(text), F.lit(0)) > 0)
    best = F.min(F.when(usable, F.struct(rank.alias("rank"), F.col("source"), text.alias("text"))))
    return (
        candidates.groupBy("project").agg(best.alias("b"))
        .select(
            "project", F.coalesce("b.source", F.lit("none")).alias("source"),
            F.coalesce("b.text", F.lit("")).alias("text"),
        )
    )


def known(col: Column, names: tuple[str, ...], default: str) -> Column:
    """Lower-cased value if it is one of ``names``, else ``default``."""
    low = F.lower(col)
    return F.when(low.isin(*names), low).otherwise(F.lit(default))


def assertion_results(assertions: DataFrame, results: DataFrame) -> DataFrame:
    """Results with what was asserted, on (intent_id, idx)."""
    return assertions.join(results, ["intent_id", "idx"])


def fidelity(results: DataFrame) -> DataFrame:
    """(intent_id, fidelity_raw, fidelity_score): weighted score in percent; 0 without weight.

    The sums are decimal, so the score does not depend on the order in which tasks add up.
    """
    def total(c: Column) -> Column:
        return F.sum(c.cast("decimal(28,9)")).cast("double")

    weight = total(F.col("importance"))
    raw = F.when(weight != 0, total(F.col("score") * F.col("importance")) / weight * 100).otherwise(0.0)
    return (
        results.groupBy("intent_id").agg(F.count(F.lit(1)).alias("results"), raw.alias("fidelity_raw"))
        .withColumn("fidelity_score", F.bround("fidelity_raw", 1))
    )


def intent_findings(results: DataFrame, *keep: str) -> DataFrame:
    """Findings for assertions that failed or hold in part.

    ``results``: project, intent_id, idx, type, description, expect, importance, status,
    evidence, location; ``keep`` names columns of it to carry along.
    """
    status = known(F.col("status"), ASSERTION_STATES, "unknown")
    kind = known(F.col("type"), ASSERTION_TYPES, "behavior")
    missed = results.withColumn("_status", status).where(F.col("_status").isin("fail", "partial"))
    nothing = F.lit(None)
    return missed.select(
        "project",
        F.col("location").alias("file"),
        nothing.cast("int").alias("line_no"),
        nothing.cast("int").alias("end_line"),
        F.concat(F.lit("intent-"), kind).alias("rule_id"),
        F.when(F.col("importance") > MAJOR_ABOVE, "major").otherwise("minor").alias("severity"),
        F.lit("intent").alias("category"),
        F.concat(F.lit("Intent not met: "), "description").alias("title"),
        F.concat(
            F.lit("Expected: "), "expect", F.lit("\nStatus: "), "_status", F.lit("\nEvidence: "),
            F.coalesce("evidence", F.lit("None found")),
        ).alias("description"),
        F.concat(F.lit("Implement: "), "expect").alias("suggestion"),
        F.lit(0.8).alias("confidence"),
        F.lit("intent").alias("engine"),
        F.col("evidence"),
        F.lit(0).alias("ord"),
        F.col("idx").cast("long").alias("seq"),
        *keep,
    )
