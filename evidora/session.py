"""Sessions and the shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


def session(app: str = "evidora", **conf: str) -> SparkSession:
    """A session with the settings that the operators expect: UTC, adaptive plans."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


#: Rows of an Arrow batch where the session leaves Spark's default: texts of any length stay a few megabytes a batch.
ARROW_ROWS = "1000"
#: Bytes of a Parquet row group where the session leaves the default of 128 MB, all of which a task holds while it writes.
ROW_GROUP = str(32 << 20)


def ship(spark: SparkSession) -> None:
    """Make a session ready: this package goes to the executors' Python workers, once for each context; Arrow batches and Parquet row groups are small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, ARROW_ROWS)
    if spark.conf.get("parquet.block.size", None) is None:
        spark.conf.set("parquet.block.size", ROW_GROUP)
    sc = spark.sparkContext
    if getattr(sc, "_evidora_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="evidora-ship-")
    path = os.path.join(folder, "evidora_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._evidora_shipped = True
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
