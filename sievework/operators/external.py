"""Reviews made elsewhere, taken in as data: text with JSON in it becomes checked rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import strip
from sievework.operators.intent import known
from sievework.schema import ASSERTION_TYPES, SEVERITY_RANK

# Names a review may use and what stands in for anything else.
FILE_CATEGORIES = ("security", "performance", "logic", "import", "ai_pattern", "style")
PROJECT_CATEGORIES = ("security", "performance", "logic", "ai_pattern")
SEVERITIES = tuple(SEVERITY_RANK)
DEFAULT_CONFIDENCE = 0.7
DEFAULT_IMPORTANCE = 0.8
STEP_FIELDS = ["observation", "feeling", "friction", "action", "target", "reasoning"]

_ISSUE = "array<struct<severity:string,category:string,title:string,description:string,file:string,line:string,suggestion:string,confidence:string>>"
_ASSERTION = "array<struct<type:string,description:string,expect:string,importance:string>>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is mentioned."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _unfenced(text: Column, last: bool) -> Column:
    tagged = F.split(text, "```json")
    body = (
        F.when(text.contains("```json"), F.element_at(tagged, -1) if last else F.try_element_at(tagged, F.lit(2)))
        .when(text.contains("```"), F.try_element_at(F.split(text, "```"), F.lit(2)))
        .otherwise(text)
    )
    return strip(F.substring_index(body, "```", 1))


def json_text(text: Column, last: bool = False) -> Column:
    """Content of the first (or last) ```json fence, else of the first plain fence, else all."""
    return _once(text, lambda t: _unfenced(t, last))


def _list_of(payload: Column, kind: str) -> Column:
    """The JSON list in a payload; null for anything else."""
    return _once(json_text(payload), lambda t: F.when(t.startswith("["), F.from_json(t, kind)))


def _entries(raw: DataFrame, body: Column, *keep: str, at: str, name: str) -> DataFrame:
    """A row per entry of the list ``body``; no rows for null and for an empty list.

    The plain generator makes Spark filter on the size of the list below it, where all that the list is parsed from
    is written out again at each mention; the outer one does not, so each payload is parsed once.
    """
    each = raw.select(*keep, body.alias("_body")).select(*keep, F.posexplode_outer("_body").alias(at, name))
    return each.where(F.col(at).isNotNull())


def _fraction(value: Column, default: float) -> Column:
    """Number in [0, 1]; the default if absent, null if unusable."""
    n = F.when(value.isNull(), F.lit(default)).otherwise(value.try_cast("double"))
    return F.when((n >= 0) & (n <= 1), n)


def _line(value: Column) -> Column:
    return F.nullif(value.try_cast("int"), F.lit(0))


def _findings(raw: DataFrame, severity: str, categories: tuple, file: Column, located: Column,
              title: str, engine: str, rule_id: str) -> DataFrame:
    i = F.col("i")
    conf = _fraction(i["confidence"], DEFAULT_CONFIDENCE)
    # a line that is no number makes the whole entry unusable
    usable = conf.isNotNull() & (i["line"].isNull() | i["line"].try_cast("int").isNotNull())
    return raw.where(usable).select(
        "project",
        F.when(located, file).alias("file"),
        F.when(located, _line(i["line"])).alias("line_no"),
        F.lit(None).cast("int").alias("end_line"),
        F.lit(rule_id).alias("rule_id"),
        known(i["severity"], SEVERITIES, severity).alias("severity"),
        known(i["category"], categories, "logic").alias("category"),
        F.coalesce(i["title"], F.lit(title)).alias("title"),
        F.coalesce(i["description"], F.lit("")).alias("description"),
        i["suggestion"].alias("suggestion"),
        conf.alias("confidence"),
        F.lit(engine).alias("engine"),
        F.lit(None).cast("string").alias("evidence"),
        F.lit(0).alias("ord"),
        F.col("seq").cast("long").alias("seq"),
    )


def file_reviews(payloads: DataFrame) -> DataFrame:
    """Findings of reviews of one file; ``payloads``: project, path, payload.

    The payload is an object with a list ``issues``; anything else gives no rows.
    """
    body = F.from_json(json_text(F.col("payload")), f"struct<issues:{_ISSUE}>")
    raw = _entries(payloads, body["issues"], "project", "path", at="seq", name="i")
    line = _line(F.col("i")["line"])
    return _findings(raw, "minor", FILE_CATEGORIES, F.col("path"), line.isNotNull(),
                     "LLM-detected issue", "llm", "llm-review")


def project_reviews(payloads: DataFrame) -> DataFrame:
    """Findings of reviews of a whole project; ``payloads``: project, payload (a JSON list)."""
    raw = _entries(payloads, _list_of(F.col("payload"), _ISSUE), "project", at="seq", name="i")
    file = F.col("i")["file"]
    return _findings(raw, "major", PROJECT_CATEGORIES, file, F.coalesce(file, F.lit("")) != "",
                     "Deep analysis finding", "deep-holistic", "holistic-review")


def assertions(payloads: DataFrame) -> DataFrame:
    """(intent_id, idx, type, description, expect, importance) from JSON lists of assertions."""
    raw = _entries(payloads, _list_of(F.col("payload"), _ASSERTION), "intent_id", at="idx", name="a")
    a = F.col("a")
    return raw.select(
        "intent_id", "idx",
        known(F.coalesce(a["type"], F.lit("behavior")), ASSERTION_TYPES, "behavior").alias("type"),
        F.coalesce(a["description"], F.lit("")).alias("description"),
        F.coalesce(a["expect"], F.lit("")).alias("expect"),
        _fraction(a["importance"], DEFAULT_IMPORTANCE).alias("importance"),
    ).where(F.col("importance").isNotNull())


def step_evaluations(payloads: DataFrame) -> DataFrame:
    """Step evaluations; text without a JSON object counts as confused, with a scroll.

    Keeps the columns of ``payloads`` except ``payload``.
    """
    fields = ", ".join(f"{f} string" for f in STEP_FIELDS)
    parsed = F.from_json(
        json_text(F.col("payload"), last=True), f"{fields}, _bad string",
        {"columnNameOfCorruptRecord": "_bad"},
    )
    rest = [c for c in payloads.columns if c != "payload"]
    failed = F.col("e").isNull() | F.col("e._bad").isNotNull()
    fallback = {
        "observation": "Evaluation failed", "feeling": "confused", "action": "scroll", "target": "",
        "reasoning": "unreadable evaluation",
    }
    return payloads.select(*rest, parsed.alias("e")).select(
        *rest,
        *[
            F.when(failed, F.lit(fallback.get(f)).cast("string")).otherwise(F.col(f"e.{f}")).alias(f)
            for f in STEP_FIELDS
        ],
    )
