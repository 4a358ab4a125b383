"""Writing results.  Every writer replaces exactly the partitions it writes, so a job that is
run again after a failure leaves no duplicates."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.history import issue_rows, scan_rows
from sievework.operators.report import ORDER, json_records, markdown
from sievework.schema import FILE
from sievework.sources.keyed import KeyedTable
from sievework.sources.stage import staged


def _replace_scan(df: DataFrame, table: str, scan_mode: str, scan_id: int) -> None:
    """Writes one scan's partition of a table, also if it has no rows."""
    path = f"{table}/scan_mode={quote(scan_mode, safe='')}/scan_id={scan_id}"
    df.drop("scan_mode", "scan_id").write.mode("overwrite").parquet(path)


def write_files(files: DataFrame, table: str, buckets: int) -> None:
    """File table by language, bucketed and sorted by (project, path).

    Windows and joins on (project, path) then need no exchange, and readers of one language
    or of manifests (no language) skip the rest.
    """
    (
        files.write.mode("overwrite").partitionBy("language")
        .bucketBy(buckets, *FILE).sortBy(*FILE).saveAsTable(table)
    )


def write_issue_table(log: DataFrame, table: str, buckets: int) -> None:
    """Issue log by scan mode, bucketed and sorted by (project, fingerprint).

    The questions that follow an issue through the scans (``quality_delta_by_print``, ``lifecycle_by_print``) then
    need no exchange of log rows; a project of any size is spread over the buckets.
    """
    by = ["scan_mode"] if "scan_mode" in log.columns else []
    log.write.mode("overwrite").partitionBy(*by).bucketBy(buckets, "project", "fingerprint").sortBy("project", "fingerprint").saveAsTable(table)


class LifecycleTable:
    """Lifecycle of issues kept up to date scan by scan: per fingerprint its first and last scan and how often it was seen.

    One update reads the state and one scan's rows, not the log.  An update that is repeated gives the same.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        key = "project string, scan_mode string, fingerprint string"
        self.spark, self.root = spark, root
        self.state = KeyedTable(spark, f"{root}/prints", key, "first_scan long, last_scan long, seen long", ["project", "fingerprint"], buckets=buckets)

    def update(self, step: int, issues: DataFrame, scans: DataFrame) -> None:
        """Takes in one scan: update number ``step`` (0, 1, …), its log rows, and (project, scan_mode, scan_id, prev_id) of each project in it."""
        keys = ["project", "scan_mode"]
        now = issues.select(*keys, "fingerprint").distinct().withColumn("here", F.lit(True))
        old = self.state.before(step).join(scans.select(*keys), keys, "left_semi")
        both = staged(old.join(now, [*keys, "fingerprint"], "full").join(scans.select(*keys, "scan_id", "prev_id"), keys))
        here, last = F.col("here").isNotNull(), F.coalesce(F.col("last_scan") == F.col("prev_id"), F.lit(False))
        status = F.when(here & last, "recurring").when(here, "new").otherwise("fixed")
        told = both.where(here | last).select(*keys, "scan_id", "fingerprint", status.alias("status"))
        told.write.mode("overwrite").parquet(f"{self.root}/status/step={step}")
        changed = both.where(here).select(
            *keys, "fingerprint", F.coalesce("first_scan", "scan_id").alias("first_scan"), F.col("scan_id").alias("last_scan"),
            (F.coalesce("seen", F.lit(0)) + 1).alias("seen"), F.lit(False).alias("gone"),
        )
        self.state.put(changed, step)

    def statuses(self) -> DataFrame:
        """(project, scan_mode, scan_id, fingerprint, status) of all scans taken in."""
        schema = "project string, scan_mode string, scan_id long, fingerprint string, status string, step int"
        return self.spark.read.schema(schema).parquet(f"{self.root}/status").drop("step")


def save_scan(
    findings: DataFrame, root: str, scan_id: int, scan_mode: str = "full",
    target: str = "", duration_ms: int | None = None, scores: DataFrame | None = None,
    projects: DataFrame | None = None, carried: DataFrame | None = None, state: DataFrame | None = None,
) -> None:
    """Append one scan: its issue rows, the state of its files, then one counting row per project.

    Partitioned by scan, so a delta reads two partitions and a repeated write replaces its own.
    The counting rows are written last and make the scan visible: until then readers see the scans before it, so
    a job that dies on the way leaves no half scan.
    ``projects`` lists the scanned projects, so that one without findings gets a row of zeros;
    ``scores`` (project, fidelity_score) adds the fidelity score.  ``carried`` are log rows of files that an incremental
    scan skipped, ``state`` (project, path, md5) is what the next one compares with.
    """
    issues = issue_rows(findings, F.lit(scan_id), scan_mode)
    if carried is not None:
        issues = issues.unionByName(
            carried.withColumns({"scan_id": F.lit(scan_id).cast("long"), "scan_mode": F.lit(scan_mode)}).select(*issues.columns)
        )
    _replace_scan(issues, f"{root}/issue_log", scan_mode, scan_id)
    if state is not None:
        _replace_scan(state.select(*FILE, "md5"), f"{root}/file_state", scan_mode, scan_id)
    written = _rows(findings.sparkSession, f"{root}/issue_log", _LOG).where(
        (F.col("scan_id") == scan_id) & (F.col("scan_mode") == scan_mode)
    )
    rows = scan_rows(written)
    if projects is not None:
        rows = (
            projects.select("project").distinct().join(rows, "project", "left")
            .withColumns({"scan_id": F.lit(scan_id).cast("long"), "scan_mode": F.lit(scan_mode)})
            .fillna(0)
        )
    rows = rows.withColumns(
        {
            "timestamp": F.current_timestamp(),
            "target": F.lit(target),
            "duration_ms": F.lit(duration_ms).cast("long"),
        }
    )
    if scores is None:
        rows = rows.withColumn("fidelity_score", F.lit(None).cast("double"))
    else:
        rows = rows.join(scores.select("project", "fidelity_score"), "project", "left")
    _replace_scan(rows, f"{root}/scans", scan_mode, scan_id)


_SCANS = (
    "project string, total_issues long, critical long, major long, minor long, info long, timestamp timestamp, target string, "
    "duration_ms long, fidelity_score double, scan_mode string, scan_id long"
)
_LOG = (
    "project string, rule_id string, file string, line int, severity string, category string, title string, fingerprint string, "
    "scan_mode string, scan_id long"
)


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the history; without rows before its first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_scans(spark: SparkSession, root: str) -> DataFrame:
    return _rows(spark, f"{root}/scans", _SCANS)


def read_issue_log(spark: SparkSession, root: str) -> DataFrame:
    """Issue rows of the scans that are complete."""
    complete = read_scans(spark, root).select("project", "scan_mode", "scan_id")
    return _rows(spark, f"{root}/issue_log", _LOG).join(complete, ["project", "scan_mode", "scan_id"], "left_semi")


def last_scans(spark: SparkSession, root: str, scan_mode: str, before: int) -> DataFrame:
    """(project, scan_id): each project's latest complete scan before ``before``."""
    scans = read_scans(spark, root).where((F.col("scan_mode") == scan_mode) & (F.col("scan_id") < before))
    return scans.groupBy("project").agg(F.max("scan_id").alias("scan_id"))


def last_state(spark: SparkSession, root: str, scan_mode: str, before: int) -> DataFrame:
    """(project, path, md5) of the files at each project's latest complete scan before ``before``."""
    states = _rows(spark, f"{root}/file_state", "project string, path string, md5 string, scan_mode string, scan_id long")
    states = states.where((F.col("scan_mode") == scan_mode) & (F.col("scan_id") < before))
    return states.join(last_scans(spark, root, scan_mode, before), ["project", "scan_id"], "left_semi").select(*FILE, "md5")


def last_issues(spark: SparkSession, root: str, scan_mode: str, before: int) -> DataFrame:
    """Issue rows of each project's latest complete scan before ``before``."""
    log = _rows(spark, f"{root}/issue_log", _LOG).where((F.col("scan_mode") == scan_mode) & (F.col("scan_id") < before))
    return log.join(last_scans(spark, root, scan_mode, before), ["project", "scan_id"], "left_semi")


def write_json_report(findings: DataFrame, path: str, target: Column | None = None, **parts: object) -> None:
    """JSON lines: summaries, findings and checked assertions, in separate folders; ``parts`` as for ``json_records``."""
    json_records(findings, target, **parts).select("record", F.col("body").alias("value")).write.mode(
        "overwrite"
    ).partitionBy("record").text(path)


def write_markdown_report(findings: DataFrame, path: str, **parts: object) -> None:
    """Report lines, globally in order: the files of the folder in name order are the reports."""
    markdown(findings, **parts).orderBy(*ORDER).select(F.col("text").alias("value")).write.mode(
        "overwrite"
    ).text(path)
