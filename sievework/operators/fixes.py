"""Proposed fixes: the text around an issue, confidence checks, applying them to file tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.schema import FILE

# Lines around an issue, penalty of a fix that does not match, default bar.
AROUND = 10
PENALTY = 0.3
DEFAULT_CONFIDENCE = 0.5
MIN_CONFIDENCE = 0.7


def fix_windows(findings: DataFrame, files: DataFrame, around: int = AROUND) -> DataFrame:
    """(project, path, line_no, context): numbered lines around each distinct finding line.

    The lines of a file are gathered first, so its content is joined once and cut in place.
    """
    wanted = (
        findings.where(F.col("file").isNotNull())
        .groupBy("project", F.col("file").alias("path"))
        .agg(F.collect_set(F.coalesce("line_no", F.lit(1))).alias("at"))
    )
    lines = files.select(*FILE, "content").join(wanted, FILE).select(
        *FILE, F.split("content", "\n", -1).alias("lines"), F.explode("at").alias("line_no")
    )
    lo = F.greatest(F.col("line_no") - around, F.lit(1))
    hi = F.least(F.col("line_no") + around, F.size("lines"))
    text = F.transform(
        F.slice("lines", lo, hi - lo + 1),
        lambda l, i: F.concat((lo + i).cast("string"), F.lit(": "), l),
    )
    return lines.where(hi >= lo).select(*FILE, "line_no", F.array_join(text, "\n").alias("context"))


def rstripped(text: Column) -> Column:
    """Every line without its trailing white space."""
    return F.array_join(
        F.transform(F.split(text, "\n", -1), lambda l: F.regexp_replace(l, r"(?U)\s+$", "")), "\n"
    )


def checked_confidence(old: Column, content: Column, confidence: Column) -> Column:
    """Confidence, lowered when the old code is not in the file even without trailing blanks."""
    conf = F.coalesce(confidence, F.lit(DEFAULT_CONFIDENCE))
    absent = (
        (F.coalesce(old, F.lit("")) != "")
        & ~content.contains(old)
        & ~rstripped(content).contains(rstripped(old))
    )
    return F.when(absent, F.greatest(F.lit(0.0), conf - PENALTY)).otherwise(conf)


def usable_fixes(
    fixes: DataFrame, findings: DataFrame, files: DataFrame, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """Fixes of known findings with checked confidence, at or above the bar.

    ``fixes``: project, path, line_no, rule_id, old_code, new_code, explanation, confidence.  A fix without a
    line belongs to the finding of its file without one.
    """
    none = F.lit(-1)  # no line has this number
    about = findings.select(
        "project", F.col("file").alias("path"), F.coalesce("line_no", none).alias("_line"), "rule_id", "title", "severity"
    )
    conf = checked_confidence(F.col("old_code"), F.col("content"), F.col("confidence"))
    return (
        fixes.withColumn("_line", F.coalesce("line_no", none)).join(about, [*FILE, "_line", "rule_id"])
        .join(files.select(*FILE, "content"), FILE)
        .withColumn("confidence", conf)
        .drop("content", "_line")
        .where(F.col("confidence") >= min_confidence)
    )


def _replace_first(text: Column, old: Column, new: Column) -> Column:
    at = F.instr(text, old)
    return F.when(
        at > 0,
        F.concat(
            F.substring(text, F.lit(1), at - 1), new,
            F.substring(text, at + F.length(old), F.length(text)),
        ),
    ).otherwise(text)


def apply_fixes(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """(project, path, content, applied, tried): files with their fixes applied in line order.

    Each fix replaces the first occurrence of its old code in the text as left by the ones
    before it; without new code the old is deleted.  Files without fixes are not returned; nothing is overwritten.
    """
    step = F.struct("line_no", "rule_id", F.coalesce("old_code", F.lit("")).alias("old"), F.coalesce("new_code", F.lit("")).alias("new"))
    plan = fixes.groupBy(*FILE).agg(F.array_sort(F.collect_list(step)).alias("plan"))
    start = F.struct(F.col("content").alias("text"), F.lit(0).alias("applied"))

    def run(acc: Column, fix: Column) -> Column:
        hit = (fix["old"] != "") & acc["text"].contains(fix["old"])
        return F.struct(
            F.when(hit, _replace_first(acc["text"], fix["old"], fix["new"])).otherwise(acc["text"]).alias("text"),
            (acc["applied"] + F.when(hit, 1).otherwise(0)).alias("applied"),
        )

    done = files.select(*FILE, "content").join(plan, FILE)
    return done.select(*FILE, F.aggregate("plan", start, run).alias("r"), F.size("plan").alias("tried")).select(
        *FILE, F.col("r.text").alias("content"), F.col("r.applied").alias("applied"), "tried"
    )
