"""Sessions: a local one for tests, and what a session needs to run the package's Python functions on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.adaptive.enabled": "true", **conf}.items():
        builder = builder.config(key, value)
    return attach(builder.getOrCreate())


#: Rows that go to Python at once. Texts are long: at Spark's own default, two copies of a batch outside the heap cost an
#: executor hundreds of MB a task.
ARROW_ROWS = 1000


def attach(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors of spark, once a context, as they need not have it installed; bounds Arrow batches."""
    context = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    if getattr(context, "_codeloom_attached", False):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(prefix="codeloom-"), "codeloom.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(at)
    context._codeloom_attached = True
    return spark
