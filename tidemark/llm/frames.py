"""Helpers shared by the operators: inputs, shared-folder tables, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch on its way to Python.
BATCH_BYTES = "16m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark (so any store Spark knows will do)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session is used as it is.  Only where it is
    unset and all of Spark is one process (tests, a laptop) a temporary folder
    of this machine takes its place; on a cluster it has to be set.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back.

    This cuts the lineage: what follows survives the loss of any executor
    without computing ``df`` again, and later scans read only their columns.
    The table is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column | str, parts: int, part: int) -> Column:
    """True where crc32 of the id as text, modulo ``parts``, is ``part``."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x if x is not None else "" for x in batch.column(column).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of the texts of a batch; null counts as empty."""
    return [x if x is not None else b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what a task holds in Python stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def bounded_batches(spark: SparkSession) -> None:
    """Hold the Arrow batches that this session sends to Python at BATCH_BYTES, so that rows may be long.

    A bound of the session's own stays.  The setting is read when a query runs, so it can't be put back here.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "9223372036854775807", "-1", "64MB", "67108864b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def give_back() -> None:
    """Hand freed memory back to the system: a worker goes on to other tasks, and what it once needed would stay its own."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over small slices of Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(slices(batches))
        give_back()

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
