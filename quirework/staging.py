"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where neither that nor a checkpoint folder is
    set (local runs) a temporary one is made."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quirework-"))
    return sc.getCheckpointDir()


def staged(df: DataFrame, tag: str) -> DataFrame:
    """The table written to the shared folder and read again, so that what uses it
    more than once doesn't compute it again."""
    path = f"{shared_dir(df.sparkSession)}/quirework/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # shuffle files go when the driver collects its garbage, which may take until
    # the disk is full: those of the finished write go now
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)
