"""Tables that several steps read: written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh one where that is unset in local mode. Raises on a cluster that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="evidora-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/evidora-{what}-{uuid.uuid4().hex}"


def put_if_absent(spark: SparkSession, path: str, body: str) -> bool:
    """Make a file with the given text, whole or not at all, unless it is there; whether it was made. Of several writers one makes it.

    Local files: a hard link, which fails on a name in use. HDFS: a rename that overwrites nothing. Other stores: their conditional
    create, under which a file comes to be when it is closed.
    """
    from py4j.protocol import Py4JJavaError

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    p = Path(path)
    fs = p.getFileSystem(conf)
    fs.mkdirs(p.getParent())
    real = fs.resolvePath(p.getParent())  # a view names another file system
    fs, p = real.getFileSystem(conf), Path(real, p.getName())
    scheme = fs.getUri().getScheme()
    at = Path(real, f".waiting-{uuid.uuid4().hex}") if scheme in ("file", "hdfs") else p
    try:
        out = fs.create(at, False)
        out.write(bytearray(body.encode()))
        out.close()
        if scheme == "file":
            jvm.java.nio.file.Files.createLink(jvm.java.io.File(p.toUri().getPath()).toPath(), jvm.java.io.File(at.toUri().getPath()).toPath())
        elif scheme == "hdfs":
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(at, p, none)
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName() or fs.exists(p):
            return False
        raise
    finally:
        if at is not p:
            fs.delete(at, False)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, what: str = "table") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and what is read survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._evidora_path = path
    _made.append(path)
    return out


def small_side(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The side of a join, broadcast where its rows, which are counted, are few."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def deal(df: DataFrame, *keys: str, each: int = 250_000) -> DataFrame:
    """The rows of a table dealt out over tasks of about `each` rows, one a core at least; by keys, or in turn."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // each)), *keys)


#: Rows that a task sorts or hashes at once: a few hundred megabytes in the plans of narrow tables.
TASK_ROWS = 250_000


def shuffle_tasks(*tables: DataFrame, each: int = TASK_ROWS) -> int | None:
    """Tasks for a shuffle of tables, whose rows are counted, with about `each` rows in one; None where those of the session do."""
    n = -(-sum(t.count() for t in tables) // each)
    return n if n > int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def spread(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """The rows by keys over n tasks; as they are where n is None."""
    return df.repartition(n, *keys) if n else df


def release(*tables: DataFrame) -> None:
    """Delete tables made by materialize() that no later plan reads."""
    for t in tables:
        drop_path(t.sparkSession, t._evidora_path)
        if t._evidora_path in _made:
            _made.remove(t._evidora_path)


def release_all(spark: SparkSession) -> None:
    """Delete every table that materialize() has made and that is still there: when no result is read any more."""
    while _made:
        drop_path(spark, _made.pop())
