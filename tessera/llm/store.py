"""Shared storage for intermediate tables: the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows per Arrow batch handed to Python: small, because rows hold whole texts.
ARROW_ROWS = 512
ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: One list of written tables for each open scope; the first is the process's own.
_written: list[list[str]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a new temporary folder only in local mode where none is set (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope():
    """Collects the paths that durable() writes inside; the caller releases them once what was made of them is stored."""
    _written.append(own := [])
    try:
        yield own
    finally:
        _written.pop()


def hand_on(paths: list[str]) -> None:
    """Tables of a scope that has ended, and that the scope around it is to release."""
    _written[-1].extend(paths)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete the tables of a scope (default: all written outside of one).  Only for callers whose results are already stored.

    The driver's collector is asked to run, because Spark drops the shuffle files and broadcasts of finished jobs only once their plans are collected.
    What the driver's Python has freed goes back to the system, too.
    """
    paths = _written[0] if paths is None else paths
    while paths:
        remove(spark, paths.pop())
    trim()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give freed memory of this Python process back to the system; glibc keeps it where small pieces were freed between others."""
    gc.collect()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts must stay small, so that Python workers keep within their memory."""
    spark.conf.set(ARROW, str(ARROW_ROWS))


@contextmanager
def batches(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for the jobs run inside; the session's own setting after it."""
    before = spark.conf.get(ARROW)
    spark.conf.set(ARROW, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW, before)
