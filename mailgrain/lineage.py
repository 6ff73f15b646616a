"""Cutting lineage in a way that survives lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors, read from the session. Only a local session without one gets a temporary
    folder: on a cluster, executors couldn't read it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="mailgrain-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    scratch_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: compressed, and read by the columns that are asked for. For tables of
    many columns or rows; a checkpoint writes whole rows as they are in memory."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one for tables of this session; it is removed at the session's end."""
    path = f"{scratch_dir(spark)}/mailgrain-{name}-{uuid.uuid4().hex}"
    atexit.register(remove_folder, spark, path)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone; what stays is only space
        pass
