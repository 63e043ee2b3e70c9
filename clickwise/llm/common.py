"""Helpers shared by the operators: table reads, ASCII folding, materialising."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clickwise.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table through Spark's reader; ``columns`` prune the scan."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def ascii_lower(text: Column | str) -> Column:
    """Lower-case A-Z only; null counts as the empty string."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.translate(text, UPPER, UPPER.lower())


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage: a reliable checkpoint in the
    shared folder the session names, so it outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Rows of a narrow key list (a few numbers each) that every task may hold.
BROADCAST_ROWS = 300_000


def broadcast_if_small(keys: DataFrame) -> DataFrame:
    """``keys`` (materialised, a few numbers per row) with a broadcast hint if it has
    at most BROADCAST_ROWS rows; beyond that Spark shuffles the join."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def release_memory() -> None:
    """Give a Python worker's free memory back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it holds
        pass


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, giving memory back at the end of each task: workers live on, and
    what idle ones hold adds up beside the executor's heap."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()
    return wrapped
