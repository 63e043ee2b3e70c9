"""Minute table semantics: versioned log, latest-wins reads, sum collapse,
compaction (AGG-7, AGG-10, AGG-11, SRC-4).

The stream writes every (re-)emission of a window as a new row versioned by
``(batch_id, emit_seq)``; a read keeps the latest version per key.  That is
what the reference's replacing table does at merge time (or with FINAL).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clickwise.schemas import GROUP_KEYS

MINUTE_KEY = ("window_start", *GROUP_KEYS)
VALUE_COLS = ("advertiser_id", "click_count", "unique_sessions")


def latest_wins(log: DataFrame, key=MINUTE_KEY, values=VALUE_COLS,
                version=("batch_id", "emit_seq")) -> DataFrame:
    """AGG-7 / SRC-4: one row per key, the values of its highest version.

    ``max_by`` is an ordinary aggregate with a map-side partial, so a key with
    many versions never gathers its rows in one place.
    """
    extra = [c for c in log.columns if c not in (*key, *values, *version)]
    vals = [*values, *extra]
    top = F.max_by(F.struct(*vals), F.struct(*version)).alias("_v")
    return log.groupBy(*key).agg(top, F.max(F.struct(*version)).alias("_ver")) \
              .select(*key, *[F.col("_v")[c].alias(c) for c in vals],
                      *[F.col("_ver")[c].alias(c) for c in version])


def sum_collapse(rows: DataFrame, key, sums=("click_count", "unique_sessions")) -> DataFrame:
    """AGG-10: rows sharing a sort key collapse into one with summed values.

    A key whose sums are all zero disappears (the summing engine drops it)."""
    out = rows.groupBy(*key).agg(*[F.sum(c).cast("long").alias(c) for c in sums])
    nonzero = None
    for c in sums:
        cond = F.col(c) != 0
        nonzero = cond if nonzero is None else (nonzero | cond)
    return out.filter(nonzero)


def compact_months(spark, table_path: str, months: list[int] | None = None) -> list[int]:
    """AGG-11 on a batch-written minute table: rewrite month partitions with only their
    latest rows; each month is swapped in whole.  The tables of a streaming job are compacted
    beside the stream by ``streaming.minutes.compact_tables``; this refuses them."""
    from clickwise.sinks.tables import replace_months
    from clickwise.sources import fs
    if "batch_id" in fs.partition_columns(spark, table_path):
        raise ValueError(f"{table_path} belongs to a streaming job: use compact_tables on its base folder")
    fs.recover(spark, table_path)
    df = spark.read.parquet(table_path)
    if months:
        df = df.filter(F.col("month").isin(months))
    return replace_months(latest_wins(df, key=(*MINUTE_KEY, "month")), table_path, "window_start")
