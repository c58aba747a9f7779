"""Shared pieces: scratch tables on the cluster's shared folder, ASCII folding, size-checked broadcasts, workers' memory."""

from __future__ import annotations

import ctypes
import string
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space bytes of the contracts, space and 0x09 to 0x0D.
WHITE = b" \t\n\x0b\x0c\r"

_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def _local(spark: SparkSession) -> str:
    """A folder of our own for one application on a local master."""
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not hasattr(spark.sparkContext, "_tallyspark_dir"):
        spark.sparkContext._tallyspark_dir = tempfile.mkdtemp(prefix="tallyspark-")
    return spark.sparkContext._tallyspark_dir


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one of our own, on a local master only."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return folder.rstrip("/") if folder else _local(spark)


def _path(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def at_exit(spark: SparkSession, path: str) -> None:
    """Delete path when the driver's JVM ends."""
    files, where = _path(spark, path)
    files.deleteOnExit(where)


def delete(spark: SparkSession, path: str) -> None:
    files, where = _path(spark, path)
    files.delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that cut() writes inside are deleted at the end; so results must be written before it.

    Outside of any such block they stay until the driver ends, as a query is only computed by its caller.
    """
    paths: list[str] = []
    before = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(before)
        for path in paths:
            delete(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, so lost executors cost no recomputation."""
    spark, path, paths = df.sparkSession, f"{shared_dir(df.sparkSession)}/tallyspark-{uuid.uuid4().hex}", _scope.get()
    if paths is None:
        at_exit(spark, path)
    else:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return to the system what this worker has freed: workers are used again, by other stages, and malloc and Arrow keep it for them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function of a task's batches, with give_back() after its last."""

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return then


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def whole(text_col: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce((F.col(f"`{text_col}`") if isinstance(text_col, str) else text_col).cast("string"), F.lit(""))


def packed(df: DataFrame) -> DataFrame:
    """df's rows as one struct named r, so that no helper column can clash with theirs."""
    return df.select(F.struct("*").alias("r"))


def field(name: str) -> Column:
    """A column of packed() rows."""
    return F.col(f"r.`{name}`")


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, counted; beyond that Spark joins by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df
