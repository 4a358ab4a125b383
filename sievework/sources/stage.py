"""Intermediate tables that several branches of a job read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder below the cluster's ``spark.checkpoint.dir``.

    That folder is on shared storage, so a lost executor loses nothing.  Where it is unset, a folder that the
    caller gave with ``setCheckpointDir`` is taken; in local mode, where one machine does all,
    a temporary folder.  A cluster without either is an error, since executors would write to
    their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if base is None and context._jsc.sc().getCheckpointDir().isDefined():
        base = context._jsc.sc().getCheckpointDir().get()
    if base is None and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        base = tempfile.mkdtemp(prefix="run-")
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    For results that cost a pass over all content but are small themselves (the file index,
    findings) and that a job uses more than once.
    """
    path = shared_folder(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of ``shared_folder`` that no plan reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
