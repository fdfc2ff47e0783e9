"""Tables that are written once in a folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """The name of a new folder below spark.checkpoint.dir, made and marked for deletion at the driver's end.

    Where the setting is missing, a temporary folder serves in local mode, where driver and executors are one process; elsewhere that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix=f"tessera-{label}-")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """df, written as Parquet and read back: lost executors cost no work before it."""
    path = f"{shared_folder(df.sparkSession, label)}/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def listing(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """(path, length, modification time) of all files below a path: what a stored result that was made from them depends on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return ()
    found, out = files.listFiles(at, True), []
    while found.hasNext():
        s = found.next()
        out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return tuple(sorted(out))
