"""Session settings the jobs expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Only behaviour that results or skew handling depend on.  Cluster sizing
# (executors, memory, shuffle partitions) stays with spark-submit.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even when the join output feeds another exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # JS template literals hold ${...}; never rewrite them inside SQL text
    "spark.sql.variable.substitute": "false",
    # rows hold whole files; keep the batches sent to Python small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    # call-site capture costs more than the call itself when plans are built from many columns
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "sievework", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """The shared checkpoint folder of the cluster; ``fallback`` only where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if fallback:
        spark.sparkContext.setCheckpointDir(fallback)
    return fallback
