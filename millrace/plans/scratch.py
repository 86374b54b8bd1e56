"""Tables that cut a plan: written to the folder that all executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: With it Spark deletes the files of a query's exchanges when the query has ended. What is read again has been written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder, if driver and executors are one process; else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df below the shared folder and reads it back, so that lost executors cost no earlier work.

    A reader that is the last one calls `discard`; what is still there goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{root(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    spark.conf.set(CLEANUP, "true")
    at, files = _file_system(spark, path)
    files.deleteOnExit(at)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `materialize` wrote and that nothing will read again: what came from them has been written."""
    for df in tables:
        at, files = _file_system(df.sparkSession, df.written_to)
        files.delete(at, True)
        files.cancelDeleteOnExit(at)
