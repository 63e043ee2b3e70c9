"""JDBC sink of minute rows (SNK-1).

Each micro-batch's rows are appended, 500 an insert; the table has the
reference's seven columns and is read latest-wins.  A table that also has the
version columns gets them with ``versioned`` (a replayed micro-batch then appends
rows that change no answer); without them delivery is at-least-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Fixed value: rows per JDBC batch insert (reference sink setting).
JDBC_BATCH_SIZE = 500

INSERT_COLUMNS = ["window_start", "ad_id", "advertiser_id", "country", "device_type",
                  "click_count", "unique_sessions"]
VERSION_COLUMNS = ["batch_id", "emit_seq"]


def insert_projection(df: DataFrame, versioned: bool = False) -> DataFrame:
    """PRJ-9: the table's columns (window end is not stored); null country or
    device becomes 'UNKNOWN' (PRJ-3)."""
    if "window_start" not in df.columns:
        df = df.withColumn("window_start", F.timestamp_millis("window_start_ms"))
    for c in ("country", "device_type"):
        df = df.withColumn(c, F.coalesce(c, F.lit("UNKNOWN")))
    for c in ("click_count", "unique_sessions"):
        df = df.withColumn(c, F.col(c).cast("long"))
    return df.select(*INSERT_COLUMNS, *(VERSION_COLUMNS if versioned else []))


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict | None = None,
               batch_size: int = JDBC_BATCH_SIZE, versioned: bool = False) -> None:
    props = {"batchsize": str(batch_size), **(properties or {})}
    insert_projection(df, versioned).write.mode("append").jdbc(url, table, properties=props)


def jdbc_batch_writer(url: str, table: str, properties: dict | None = None,
                      batch_size: int = JDBC_BATCH_SIZE, versioned: bool = False):
    """A ``foreachBatch`` function: stamps the batch id and appends."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
        if "emit_seq" not in rows.columns:
            rows = rows.withColumn("emit_seq", F.lit(0).cast("long"))
        write_jdbc(rows, url, table, properties, batch_size, versioned)
    return write
