"""Scan history: log rows, delta between scans, lifecycle of issues, dismissals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.skew import previous_value, salted_anti_join
from sievework.functions.text import ascii_lower
from sievework.schema import SEVERITY_RANK

SUPPRESS_AFTER = 3  # fixed value: dismissals after which a rule is silenced
SCAN_KEY = ["project", "scan_mode"]


def fingerprint(rule_id: Column, file: Column, line: Column) -> Column:
    """Identity of an issue across scans; missing parts are spelled 'None'."""
    return F.concat_ws(
        ":", *[F.coalesce(c.cast("string"), F.lit("None")) for c in (rule_id, file, line)]
    )


def issue_rows(findings: DataFrame, scan_id: Column, scan_mode: str = "full") -> DataFrame:
    """Log rows of one scan."""
    return findings.select(
        "project", scan_id.cast("long").alias("scan_id"), F.lit(scan_mode).alias("scan_mode"),
        "rule_id", "file", F.col("line_no").alias("line"), "severity", "category", "title",
        fingerprint(F.col("rule_id"), F.col("file"), F.col("line_no")).alias("fingerprint"),
    )


def scan_rows(log: DataFrame) -> DataFrame:
    """One row per scan with its counts, from the issue log."""
    keys = [k for k in [*SCAN_KEY, "scan_id"] if k in log.columns]
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_issues"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK],
    )


def latest_scans(scans: DataFrame, keys: list[str], n: int = 2) -> DataFrame:
    """The ``n`` newest scans per group with their ``age`` (1 = newest).

    Spark turns the rank filter into a group limit before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("scan_id").desc())
    return scans.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def scan_history(scans: DataFrame, limit: int = 20, project: str | None = None, since: Column | None = None) -> DataFrame:
    """Newest scans first; ``since`` leaves out older ones by their ``timestamp``."""
    rows = scans if project is None else scans.where(F.col("project") == project)
    rows = rows if since is None else rows.where(F.col("timestamp") >= since)
    order = [F.col(c).desc() for c in ("timestamp", "scan_id") if c in scans.columns]
    return rows.orderBy(*order, "project").limit(limit)


def ago(span: str, now: Column | None = None) -> Column:
    """The time ``span`` before now, written as 12h, 7d or 2w."""
    units = {"h": "hours", "d": "days", "w": "weeks"}
    if not span[:-1].isdigit() or span[-1] not in units:
        raise ValueError(f"{span!r} is no span such as 30d")
    return (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {int(span[:-1])} {units[span[-1]]}")


def quality_delta(scans: DataFrame, log: DataFrame) -> DataFrame:
    """Latest scan against the one before, per project (and scan mode where there is one).

    Projects with fewer than two scans give no row.  New and fixed issues count log rows
    whose fingerprint the other scan does not have.
    """
    keys = [k for k in SCAN_KEY if k in scans.columns]
    two = latest_scans(scans, keys)
    counts = ["total_issues", "critical", "major"]

    def at(age: int, c: str) -> Column:
        return F.max(F.when(F.col("age") == age, F.col(c)))

    delta = (
        two.groupBy(*keys)
        .agg(
            at(1, "scan_id").alias("current_scan"),
            at(2, "scan_id").alias("previous_scan"),
            *[(at(1, c) - at(2, c)).alias(f"delta_{c.removesuffix('_issues')}") for c in counts],
        )
        .where(F.col("previous_scan").isNotNull())
    )
    pair = delta.select(*keys, "current_scan", "previous_scan")
    rows = log.join(
        pair.select(*keys, F.explode(F.array("current_scan", "previous_scan")).alias("scan_id"), "current_scan"),
        [*keys, "scan_id"],
    )
    # one pass over the two scans: rows per fingerprint in each, no self anti joins
    is_current = F.col("scan_id") == F.col("current_scan")
    per_print = rows.groupBy(*keys, "fingerprint").agg(
        F.count_if(is_current).alias("now"), F.count_if(~is_current).alias("before")
    )
    moved = per_print.groupBy(*keys).agg(
        F.sum(F.when(F.col("before") == 0, F.col("now")).otherwise(0)).alias("new_issues"),
        F.sum(F.when(F.col("now") == 0, F.col("before")).otherwise(0)).alias("fixed_issues"),
    )
    return delta.join(moved, keys, "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("new_issues", "fixed_issues")}
    )


def lifecycle(scans: DataFrame, log: DataFrame) -> DataFrame:
    """(keys, scan_id, fingerprint, status): new, recurring or fixed at each scan.

    Every row of the log is one issue seen at a scan.  It is recurring if the group's scan
    before has it too; an issue of a scan that the next one lacks is fixed there.  A first
    scan has only new issues.
    """
    keys = [k for k in SCAN_KEY if k in scans.columns]
    ids = scans.select(*keys, "scan_id").distinct()
    prev = previous_value(ids, keys, "scan_id", "prev_id")
    following = prev.where(F.col("prev_id").isNotNull()).select(
        *keys, F.col("prev_id").alias("scan_id"), F.col("scan_id").alias("next_id")
    )
    issues = log.select(*keys, "scan_id", "fingerprint").distinct()
    here = issues.join(prev, [*keys, "scan_id"]).select(
        *keys, "scan_id", "fingerprint", F.lit(1).alias("here"), F.lit(0).alias("last")
    )
    carried = issues.join(following, [*keys, "scan_id"]).select(
        *keys, F.col("next_id").alias("scan_id"), "fingerprint", F.lit(0).alias("here"), F.lit(1).alias("last")
    )
    both = here.unionByName(carried).groupBy(*keys, "scan_id", "fingerprint").agg(
        F.max("here").alias("here"), F.max("last").alias("last")
    )
    status = (
        F.when(F.col("here") == 0, "fixed").when(F.col("last") == 1, "recurring").otherwise("new")
    )
    return both.select(*keys, "scan_id", "fingerprint", status.alias("status"))


def _by_print(log: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fingerprint, at): in how many rows of which scans each fingerprint stands.

    On a log stored by (project, fingerprint) (``write_issue_table``) every group lies in one bucket and no log row moves.
    """
    return log.groupBy(*keys, "fingerprint").agg(F.collect_list("scan_id").alias("at"))


def quality_delta_by_print(scans: DataFrame, log: DataFrame) -> DataFrame:
    """``quality_delta`` for a log stored by fingerprint: the log is reduced where it lies, before anything meets it."""
    keys = [k for k in SCAN_KEY if k in scans.columns]
    ends = quality_delta(scans, log.limit(0)).drop("new_issues", "fixed_issues")
    pair = ends.select(*keys, "current_scan", "previous_scan")
    oldest = pair.agg(F.min("previous_scan")).first()[0]
    per_print = _by_print(log.where(F.col("scan_id") >= F.lit(oldest)), keys).join(pair, keys)

    def rows(scan: str) -> Column:
        return F.size(F.filter("at", lambda x: x == F.col(scan))).cast("long")

    now, before = rows("current_scan"), rows("previous_scan")
    moved = per_print.groupBy(*keys).agg(
        F.sum(F.when(before == 0, now).otherwise(0)).alias("new_issues"), F.sum(F.when(now == 0, before).otherwise(0)).alias("fixed_issues")
    )
    return ends.join(moved, keys, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("new_issues", "fixed_issues")})


def lifecycle_by_print(scans: DataFrame, log: DataFrame) -> DataFrame:
    """``lifecycle`` for a log stored by fingerprint.

    Only one row per fingerprint, with the scans that have it, meets the list of its project's scans.
    """
    keys = [k for k in SCAN_KEY if k in scans.columns]
    ids = scans.groupBy(*keys).agg(F.sort_array(F.collect_set("scan_id")).alias("ids"))
    each = _by_print(log, keys).join(ids, keys)
    status = F.transform(
        "ids",
        lambda scan, i: F.struct(
            scan.alias("scan_id"), F.array_contains("at", scan).alias("here"),
            ((i > 0) & F.array_contains("at", F.get("ids", i - 1))).alias("last"),
        ),
    )
    seen = each.select(*keys, "fingerprint", F.explode(F.filter(status, lambda x: x["here"] | x["last"])).alias("s"))
    said = F.when(~F.col("s.here"), "fixed").when(F.col("s.last"), "recurring").otherwise("new")
    return seen.select(*keys, "s.scan_id", "fingerprint", said.alias("status"))


def carry_forward(findings: DataFrame, log: DataFrame, skipped: DataFrame) -> DataFrame:
    """Log rows of files an incremental scan skipped, so they do not look fixed.

    ``log`` holds the rows of the previous scan, ``skipped`` the unchanged (project, path).
    """
    kept = log.join(skipped.select("project", F.col("path").alias("file")), ["project", "file"], "left_semi")
    shared = [c for c in findings.columns if c in log.columns]
    return findings.select(*shared).unionByName(kept.select(*shared))


def dismissal_state(events: DataFrame, clears: DataFrame | None = None) -> DataFrame:
    """(project, rule_id, file_pattern, reason, count, last_ts, auto_suppress) from dismissal events.

    ``events``: project, seq, ts, rule_id, file_pattern, reason.  ``clears``: project, seq, rule_id,
    file_pattern; without a pattern it clears every pattern of the rule.  Only events after
    the last clear of the same project count, and the first reason stays.
    """
    pattern = F.coalesce("file_pattern", F.lit(""))
    live = events.withColumn("file_pattern", pattern)
    if clears is not None:
        c = clears.select("project", "rule_id", F.col("seq").alias("at"), pattern.alias("pattern"))
        whole = c.where("pattern = ''").groupBy("project", "rule_id").agg(F.max("at").alias("at_rule"))
        some = (
            c.where("pattern <> ''").groupBy("project", "rule_id", F.col("pattern").alias("file_pattern"))
            .agg(F.max("at").alias("at_pattern"))
        )
        last = F.greatest(F.coalesce("at_rule", F.lit(-1)), F.coalesce("at_pattern", F.lit(-1)))
        live = (
            live.join(whole, ["project", "rule_id"], "left")
            .join(some, ["project", "rule_id", "file_pattern"], "left")
            .where(F.col("seq") > last)
        )
    return live.groupBy("project", "rule_id", "file_pattern").agg(
        F.min_by(F.coalesce("reason", F.lit("")), "seq").alias("reason"),
        F.count(F.lit(1)).alias("count"),
        F.max("ts").alias("last_ts"),
        (F.count(F.lit(1)) >= SUPPRESS_AFTER).alias("auto_suppress"),
    )


def dismissals(state: DataFrame) -> DataFrame:
    return state.orderBy("project", F.col("count").desc(), "rule_id", "file_pattern")


def unsuppressed(findings: DataFrame, state: DataFrame) -> DataFrame:
    """Findings no silenced dismissal of their project covers.

    A dismissal covers a rule, or the files whose path contains its pattern (LIKE wildcards,
    ASCII case ignored).  There are few rule ids, so the join is spread by a salt.
    """
    escaped = F.replace(F.col("file_pattern"), F.lit("\\"), F.lit("\\\\"))
    silent = state.where("auto_suppress").select(
        F.col("project").alias("r_project"), F.col("rule_id").alias("r_rule_id"),
        F.concat(F.lit("%"), ascii_lower(escaped), F.lit("%")).alias("like_pattern"),
        (F.col("file_pattern") == "").alias("whole_rule"),
    ).distinct()
    f = findings.withColumn("_path", ascii_lower(F.coalesce("file", F.lit(""))))
    covered = F.col("whole_rule") | F.like(F.col("_path"), F.col("like_pattern"))
    return salted_anti_join(f, silent, ["project", "rule_id"], covered, findings.columns).drop("_path")
