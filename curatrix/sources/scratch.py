"""Folders for files that one query writes and reads: in the shared folder of a cluster, or a local one of a local session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that spark.checkpoint.dir names; below one of our own only in a local session without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="curatrix-"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written below folder() and read again, so that all that reads it sees the same rows in the same parts."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes staged tables that no later step reads; others are left alone."""
    for df in tables:
        if getattr(df, "_staged", None):
            remove(df.sparkSession, df._staged)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Moves a folder; an existing target is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path(new)) or not fs.rename(path(old), path(new)):
        raise FileExistsError(new)


def put(spark: SparkSession, path: str, text: str) -> None:
    """A new file of a few characters."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, False)
    out.write(bytearray(text.encode()))
    out.close()
