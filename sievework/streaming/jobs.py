"""Streaming faces of the batch jobs.  Each shares its logic with the batch twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievework.operators.findings import findings_gate, summary
from sievework.operators.journeys import journey_aggregates, with_score
from sievework.operators.history import SUPPRESS_AFTER
from sievework.operators.imports import path_entries
from sievework.plans.scan import ScanOptions, scan
from sievework.schema import FILE, FINDING, FINDING_DDL, SEVERITY_RANK
from sievework.sources.stage import staged
from sievework.sources.keyed import KeyedTable


def run(
    df: DataFrame, out: str, checkpoint: str, mode: str = "append",
    each: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Start ``df`` into Parquet at ``out``, or into ``each`` per micro-batch.

    The default trigger works off what is there and stops.
    """
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    if each is not None:
        return writer.foreachBatch(each).start()
    return writer.format("parquet").option("path", out).start()


def _replace_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch; a repeated batch replaces its own partition."""
    (
        df.withColumn("batch_id", F.lit(batch_id).cast("long"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id").parquet(path)
    )


def file_state(spark: SparkSession, root: str) -> KeyedTable:
    """What each live path had last: its version, md5 and the batch that scanned it."""
    return KeyedTable(spark, f"{root}/state", "project string, path string", "seq long, md5 string, scanned long", FILE)


def module_state(spark: SparkSession, root: str) -> KeyedTable:
    """How many live files give each importable thing of a directory."""
    return KeyedTable(spark, f"{root}/modules", "project string, dir string, name string", "files long", ["project"])


def _moved_modules(paths: DataFrame, by: str) -> DataFrame:
    """(project, dir, name, change): what paths that come (1) or go (-1) do to the modules."""
    each = path_entries(paths, by)
    return each.groupBy("project", "dir", "name").agg(F.sum(by).alias("change"))


def scan_stream(
    versions: DataFrame, packages: DataFrame, context: DataFrame, root: str, checkpoint: str,
    options: ScanOptions = ScanOptions(), trigger: dict | None = None,
) -> StreamingQuery:
    """Scan file versions as they arrive.

    ``versions`` is a stream of file rows with a ``seq`` that orders the versions of a path and, optionally, a
    flag ``deleted``.  A file is complete inside one row, so a micro-batch is scanned by the batch job;
    only files whose md5 differs from the last one are scanned, also when an older text returns.  A
    version older than the last one of its path is late and ignored; a deleted path is forgotten.  Local modules are looked up among
    the live paths, those of this batch included.  State is kept per path and per module
    (``KeyedTable``); a batch reads the buckets its own paths and projects fall into.
    """
    flagged = versions if "deleted" in versions.columns else versions.withColumn("deleted", F.lit(False))

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        files, modules = file_state(spark, root), module_state(spark, root)
        keys = batch.select(*FILE, "seq", "md5", F.coalesce("deleted", F.lit(False)).alias("deleted"))
        newest = keys.groupBy(*FILE).agg(F.max_by(F.struct("seq", "md5", "deleted"), "seq").alias("n")).select(*FILE, "n.*")
        before = files.before(batch_id, newest).withColumnsRenamed({"seq": "old_seq", "md5": "old_md5"}).drop("scanned")
        known = F.col("old_seq").isNotNull()
        moved = newest.join(before, FILE, "left").where(~known | (F.col("seq") > F.col("old_seq"))).select(
            *FILE, "seq", "md5", "deleted", known.alias("known"), (~F.col("deleted") & ~F.col("md5").eqNullSafe(F.col("old_md5"))).alias("changed")
        )
        moved = staged(moved.where(F.col("changed") | (F.col("deleted") & F.col("known"))))  # contents move in this join only
        todo = batch.join(moved.where("changed").select(*FILE, "seq"), [*FILE, "seq"]).dropDuplicates(FILE)
        todo = staged(todo.drop("deleted"))

        step = F.when(F.col("deleted"), -1).when(~F.col("known"), 1)
        steps = _moved_modules(moved.withColumn("step", step).where("step IS NOT NULL"), "step")
        had = modules.before(batch_id, moved.select("project").union(spark.range(1).select(F.lit(""))))
        now = steps.join(had, ["project", "dir", "name"], "left").where("change <> 0")
        now = staged(now.select("project", "dir", "name", (F.coalesce("files", F.lit(0)) + F.col("change")).alias("files")))
        lookup = had.join(now, ["project", "dir", "name"], "left_anti").unionByName(now.where("files > 0"))

        found = scan(todo, packages, options, context=context, lookup=lookup.drop("files"))
        _replace_batch(found, f"{root}/findings", batch_id)
        modules.put(now.withColumn("gone", F.col("files") <= 0), batch_id)
        files.put(moved.select(*FILE, "seq", "md5", F.lit(batch_id).cast("long").alias("scanned"), F.col("deleted").alias("gone")), batch_id)

    return run(flagged, "", checkpoint, each=each, trigger=trigger)


def current_findings(spark: SparkSession, root: str, batches: int) -> DataFrame:
    """Findings of the files as they are after the first ``batches`` micro-batches; those of older versions are left out."""
    live = file_state(spark, root).before(batches).select("project", F.col("path").alias("file"), F.col("scanned").alias("batch_id"))
    found = spark.read.schema(f"{FINDING_DDL}, batch_id long").parquet(f"{root}/findings")
    return found.join(live, ["project", "file", "batch_id"]).select(*FINDING)


def dismissal_counts(events: DataFrame) -> DataFrame:
    """Running dismissal counts per project, rule and pattern (update mode)."""
    return (
        events.groupBy("project", "rule_id", F.coalesce("file_pattern", F.lit("")).alias("file_pattern"))
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("auto_suppress", F.col("count") >= SUPPRESS_AFTER)
    )


class DismissalState:
    """Dismissals and clears as they stand: the live dismissals, the last clear of every rule and pattern, the counts."""

    def __init__(self, spark: SparkSession, root: str):
        spread = ["project", "rule_id"]
        key = "project string, rule_id string, file_pattern string"
        self.events = KeyedTable(spark, f"{root}/events", f"{key}, seq long", "ts timestamp, reason string", spread)
        self.clears = KeyedTable(spark, f"{root}/clears", key, "at long", spread)
        self.counts = KeyedTable(spark, f"{root}/counts", key, "reason string, count long, last_ts timestamp, auto_suppress boolean", spread)


def dismissal_stream(rows: DataFrame, root: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keeps dismissal counts up to date over dismissals and clears, in whatever order they arrive.

    ``rows`` is a stream of project, seq, ts, rule_id, file_pattern, reason and ``clear``, which is true for a
    clear.  What counts is the sequence, not the arrival: a clear silences the dismissals before it also
    if it comes late, and a late dismissal does not count if a clear after it is known.  The result is that
    of ``dismissal_state`` over all rows so far.  A batch reads and writes the rules it touches.
    """
    key = ["project", "rule_id", "file_pattern"]

    def each(batch: DataFrame, batch_id: int) -> None:
        state = DismissalState(batch.sparkSession, root)
        new = batch.withColumn("file_pattern", F.coalesce("file_pattern", F.lit("")))
        touched = staged(new.select("project", "rule_id").distinct())
        old_clears = state.clears.before(batch_id, touched)
        cleared = new.where("clear").groupBy(*key).agg(F.max("seq").alias("at"))
        clears = staged(old_clears.unionByName(cleared).groupBy(*key).agg(F.max("at").alias("at")))
        had = state.events.before(batch_id, touched).join(touched, ["project", "rule_id"], "left_semi")
        come = new.where("NOT clear").select(*key, "seq", F.col("ts").cast("timestamp").alias("ts"), "reason")
        events = had.withColumn("had", F.lit(True)).unionByName(come.withColumn("had", F.lit(False)))
        whole = clears.where("file_pattern = ''").select("project", "rule_id", F.col("at").alias("at_rule"))
        some = clears.where("file_pattern <> ''").withColumnRenamed("at", "at_pattern")
        last = F.greatest(F.coalesce("at_rule", F.lit(-1)), F.coalesce("at_pattern", F.lit(-1)))
        judged = events.join(whole, ["project", "rule_id"], "left").join(some, key, "left").withColumn("gone", F.col("seq") <= last)
        judged = staged(judged.select(*key, "seq", "ts", "reason", "had", "gone").dropDuplicates([*key, "seq"]))
        now = judged.where("NOT gone").groupBy(*key).agg(
            F.min_by(F.coalesce("reason", F.lit("")), "seq").alias("reason"), F.count(F.lit(1)).alias("count"), F.max("ts").alias("last_ts")
        ).withColumn("auto_suppress", F.col("count") >= SUPPRESS_AFTER)
        empty = judged.select(*key).distinct().join(now.select(*key), key, "left_anti")
        zeros = empty.selectExpr(*key, "CAST(NULL AS STRING) AS reason", "0L AS count", "CAST(NULL AS TIMESTAMP) AS last_ts", "false AS auto_suppress")
        state.counts.put(now.withColumn("gone", F.lit(False)).unionByName(zeros.withColumn("gone", F.lit(True))), batch_id)
        state.clears.put(clears.join(touched, ["project", "rule_id"], "left_semi").withColumn("gone", F.lit(False)), batch_id)
        state.events.put(judged.where("had = gone"), batch_id)  # new ones that count, old ones that no longer do

    return run(rows, "", checkpoint, each=each, trigger=trigger)


def keep_latest(root: str) -> Callable[[DataFrame, int], None]:
    """Writer for update mode: changed rows per batch; ``read_latest`` picks the newest."""
    return lambda batch, batch_id: _replace_batch(batch, root, batch_id)


def read_latest(spark: SparkSession, root: str, *keys: str) -> DataFrame:
    rows = spark.read.parquet(root)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")


def issue_rate(issues: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Issues per project and event-time window; rows later than ``late`` are dropped."""
    return (
        issues.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "project")
        .agg(
            F.count(F.lit(1)).alias("total_issues"),
            *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK],
        )
        .select("project", F.col("w.start").alias("window_start"), "total_issues", *SEVERITY_RANK)
    )


def journey_sessions(steps: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Scores of journeys, a journey being a user's steps without a pause of ``gap``."""
    grouped = (
        steps.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(*journey_aggregates())
    )
    return with_score(
        grouped.select("user_id", F.col("w.start").alias("session_start"), *grouped.columns[2:])
    )


def gate_counts(issues: DataFrame) -> DataFrame:
    """Running counts of each scan of a project (update mode), the same whatever the size of a micro-batch."""
    return summary(issues, "project", "scan_id").drop("engines_run")


def gate_alerts(spark: SparkSession, root: str) -> DataFrame:
    """Scans whose findings so far fail the gate, from the counts kept by ``keep_latest``."""
    counts = read_latest(spark, root, "project", "scan_id")
    gated = counts.withColumn("gate", findings_gate(F.col("critical"), F.col("major")))
    return gated.where(F.col("gate") > 0)
