"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no spark.checkpoint.dir and all tasks run in the driver's process, as in local tests.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a local folder for a local master, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith(("local[", "local-cluster")) and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that driver and executors share")
    return (found or LOCAL_CHECKPOINTS).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/notewright/{name}-{uuid.uuid4().hex}"
    atexit.register(drop_scratch, spark, path)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended before the driver
        if path.startswith("file:"):
            import shutil

            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    This cuts the lineage (a lost executor costs a file read, not a recomputation) and fixes
    values that depend on the task that made them, such as monotonically increasing ids.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of materialize() that no frame still to be computed reads, before the driver ends; other frames are left alone."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            drop_scratch(df.sparkSession, path)
