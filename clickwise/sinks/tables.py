"""Parquet table layout of the minute / hourly / daily tables (SNK-5, SNK-6, SNK-7).

Month partitions (``month=yyyymm``) give partition pruning; rows are sorted
inside each file by the table's sort key so parquet row-group statistics skip
most of a file for an advertiser/ad filter.

A write merges with the stored months it touches: rows of the same key are
replaced, all others stay.  Each touched month is written whole to a folder
beside the table and then swapped in, so a failed job leaves the old month.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from clickwise.functions.timefmt import to_yyyymm
from clickwise.operators.storage import latest_wins
from clickwise.schemas import GROUP_KEYS
from clickwise.sources import fs


def sort_key(period_col: str) -> tuple[str, ...]:
    """The stored tables' sort key."""
    return ("advertiser_id", "ad_id", period_col, "country", "device_type")


def write_sorted(df: DataFrame, path: str, period_col: str, *parts: str) -> None:
    """Write ``df`` (with its partition columns ``parts``) range-partitioned and
    sorted: sampled boundaries split a hot advertiser over many writer tasks,
    and every file holds one sorted key range."""
    key = (*parts, *sort_key(period_col))
    (df.repartitionByRange(*key).sortWithinPartitions(*key)
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path))


def replace_months(df: DataFrame, path: str, period_col: str, *parts: str) -> list[int]:
    """Swap in the months of ``df`` (with column ``month``), whole; ``parts``: further partition
    columns inside a month."""
    spark, stage = df.sparkSession, f"{path.rstrip('/')}__stage_{uuid.uuid4().hex}"
    write_sorted(df, stage, period_col, "month", *parts)
    months = [int(n.split("=")[1]) for n in fs.child_dirs(spark, stage)]
    for m in months:
        fs.swap(spark, f"{stage}/month={m}", f"{path.rstrip('/')}/month={m}")
    fs.delete(spark, stage)
    return months


def _with_period(df: DataFrame, col: str) -> DataFrame:
    if col not in df.columns and f"{col}_ms" in df.columns:
        df = df.withColumn(col, F.timestamp_millis(f"{col}_ms")).drop(f"{col}_ms")
    return df


def _merge(df: DataFrame, path: str, period_col: str, key: tuple[str, ...]) -> list[int]:
    spark = df.sparkSession
    new = df.withColumn("month", to_yyyymm(F.col(period_col)))
    fs.recover(spark, path)
    if fs.child_dirs(spark, path):
        months = [r["month"] for r in new.select("month").distinct().collect()]  # a handful
        stored = spark.read.parquet(path).filter(F.col("month").isin(months))
        both = (stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True))
        new = latest_wins(both, key=(*key, "month"), values=(), version=("_new",)).drop("_new")
    return replace_months(new, path, period_col)


def write_minute_table(df: DataFrame, path: str) -> list[int]:
    """SNK-5: minute rows with a TIMESTAMP ``window_start``.  Stored versions stay
    (readers take the latest): a row replaces only one of its own version."""
    df = _with_period(df, "window_start")
    version = tuple(c for c in ("batch_id", "emit_seq") if c in df.columns)
    return _merge(df, path, "window_start", ("window_start", *GROUP_KEYS, *version))


def write_rollup_table(df: DataFrame, path: str, period_col: str) -> list[int]:
    """SNK-6: hourly (``window_hour``) or daily (``window_day``) rows."""
    return _merge(_with_period(df, period_col), path, period_col, (period_col, "advertiser_id", *GROUP_KEYS))


def apply_retention(spark, path: str, time_col: str, now, years: int = 2) -> list[int]:
    """SNK-7 as a job: months before the horizon's are dropped as folders, by their
    names; the horizon's month is rewritten, in its own layout, without its expired rows.
    A streaming job's table loses them from its compacted rows too.  Returns the months touched."""
    from clickwise.sinks.batches import compacted_folder
    touched = _retain(spark, path, time_col, now, years)
    old = compacted_folder(spark, path.rstrip("/"))
    return sorted({*touched, *_retain(spark, old, time_col, now, years)}) if old else touched


def _retain(spark, path: str, time_col: str, now, years: int) -> list[int]:
    from clickwise.operators.retention import expired_months, horizon, retained
    fs.recover(spark, path)
    months = [int(n.split("=")[1]) for n in fs.child_dirs(spark, path) if n.startswith("month=")]
    whole = expired_months(months, now, years)
    for m in whole:
        fs.delete(spark, f"{path.rstrip('/')}/month={m}")
    cut = horizon(now, years)
    edge = cut.year * 100 + cut.month
    if edge not in months:
        return sorted(whole)
    inner = [c for c in fs.partition_columns(spark, f"{path.rstrip('/')}/month={edge}")]
    rows = spark.read.parquet(path).filter(F.col("month") == edge)
    kept = retained(rows, time_col, now, years, is_ms=time_col.endswith("_ms"))
    if not replace_months(kept, path, time_col, *inner):
        fs.delete(spark, f"{path.rstrip('/')}/month={edge}")
    return sorted([*whole, edge])
