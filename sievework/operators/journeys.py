"""Scores of user journeys from the steps taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.skew import preceding_rows
from sievework.operators.findings import JOURNEY_LIMITS, score_gate

# Points per feeling, and the limits of a score.
POINTS = {"smooth": 100, "confused": 50, "frustrated": 20, "lost": 0}
OTHER_POINTS = 50
GAVE_UP_MAX = 30
INCOMPLETE_FACTOR = 0.7
HISTORY_STEPS = 5


def step_points(feeling: Column) -> Column:
    out = F.lit(OTHER_POINTS)
    for name, n in POINTS.items():
        out = F.when(feeling == name, n).otherwise(out)
    return out


def score_of(points: Column, steps: Column, completed: Column, gave_up: Column) -> Column:
    mean = F.floor(points / F.nullif(steps, F.lit(0)))
    capped = F.when(gave_up, F.least(mean, F.lit(GAVE_UP_MAX))).otherwise(mean)
    score = F.when(completed, capped).otherwise(F.floor(capped.cast("double") * INCOMPLETE_FACTOR))
    return F.coalesce(score, F.lit(0)).cast("int")


def journey_aggregates() -> list[Column]:
    """What one group of steps adds up to; the same in batch and in a stream."""
    return [
        F.count(F.lit(1)).alias("steps"),
        F.sum(step_points(F.col("feeling"))).alias("points"),
        F.count_if(F.col("friction").isNotNull() & (F.col("friction") != "")).alias("friction_count"),
        F.count_if(F.col("feeling") == "smooth").alias("smooth_count"),
        F.coalesce(F.bool_or(F.col("action") == "done"), F.lit(False)).alias("task_completed"),
        F.coalesce(F.bool_or(F.col("action") == "give_up"), F.lit(False)).alias("gave_up"),
    ]


def with_score(aggregated: DataFrame) -> DataFrame:
    score = score_of(F.col("points"), F.col("steps"), F.col("task_completed"), F.col("gave_up"))
    return aggregated.withColumn("experience_score", score).drop("points")


def journey_scores(steps: DataFrame, *keys: str) -> DataFrame:
    keys = keys or ("journey_id",)
    return with_score(steps.groupBy(*keys).agg(*journey_aggregates()))


def worst_journey(scores: DataFrame, *keys: str) -> DataFrame:
    """Lowest score per ``keys`` (or of all; 100 without journeys) and its gate."""
    out = scores.groupBy(*keys).agg(F.coalesce(F.min("experience_score"), F.lit(100)).alias("worst"))
    return out.withColumn("gate", score_gate(F.col("worst"), JOURNEY_LIMITS))


def step_history(steps: DataFrame, n: int = HISTORY_STEPS) -> DataFrame:
    """Each step with the feelings and actions of the ``n`` steps before it."""
    item = F.concat_ws("/", "feeling", "action")
    return preceding_rows(steps, ["journey_id"], "step_num", n, item, "history")


def top_frictions(steps: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` frictions of each journey in step order."""
    first = (
        steps.where(F.col("friction").isNotNull() & (F.col("friction") != ""))
        .select("journey_id", F.struct("step_num", "friction").alias("s"))
    )
    w = Window.partitionBy("journey_id").orderBy("s.step_num")
    return (
        first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
        .select("journey_id", "rank", "s.step_num", "s.friction")
    )
