"""Prepares a session for the corpus operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Rows hold whole documents; a batch sent to Python has at most so many.
BATCH_ROWS = 2000

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's source to the job once, so that tasks import it wherever they run, and bounds Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "sievework_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("sievework", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    _done.add(app)
