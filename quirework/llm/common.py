"""What the operators share: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.shipping import ship

#: Rows of an Arrow batch that goes to Python.  Texts have any length, so the
#: batch is kept small enough for a worker's memory.
ARROW_ROWS = 1024
#: Bytes of an Arrow batch, where Spark has that setting.
ARROW_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, read by Spark (any file system it knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where neither that
    nor a checkpoint folder is set (local tests) a temporary one is made.
    """
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
    """Cut lineage: write ``df`` to the shared folder and read it again."""
    path = f"{shared_dir(df.sparkSession)}/quirework/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(
    df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with batches that fit a worker even with very long texts."""
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return df.mapInArrow(work, schema)


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def utf8(name: str = "text") -> Column:
    """The text as bytes, null as empty: Arrow hands it to Python uncopied."""
    return text_of(name).cast("binary")


def batch_of(**columns) -> pa.RecordBatch:
    """A record batch from named arrays."""
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
