"""Intermediate tables in the folder that driver and executors share.

A table written here cuts lineage: a lost executor costs the tasks it was
running, never a recomputation of what came before the table.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = java.get() if java.isDefined() else None
    if not found and spark.sparkContext.master.startswith("local"):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not found:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found.rstrip("/")


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    # What the write has shuffled is of no use after it; Spark deletes it at its end.
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    again = spark.read.schema(df.schema).parquet(path)
    again._tidemark_path = path
    return again


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`keep`, once nothing reads it any more."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        jvm = df.sparkSession._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that are done: it does when the driver drops their plans, at some time or now."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
