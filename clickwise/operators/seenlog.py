"""A stored log of seen click ids, bucketed by id (JN-3).

The log is written once per batch, hashed into a fixed number of buckets by id, so an
anti-join of later batches shuffles the batch alone: the log's rows stay where they are
and only the days that the batch's periods reach are read.

    <path>/_buckets/<n>                                    the number of buckets, fixed by the first write
    <path>/ids/seen_day=<d>/batch_id=<b>/...<bucket>.parquet

Defined results: a batch written again replaces its rows; rows without an id or a time are
not logged (such a row of a batch is never a duplicate); an empty log drops nothing; extra
columns of the batch stay.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickwise.operators.dedup import DAY_MS, anti_join_seen_batches
from clickwise.sources import fs

# Bytes of ids (some 40 each) that one bucket's rows of a day should stay within, and the bound of buckets.
BUCKET_BYTES = 128 * 1024 * 1024
MAX_BUCKETS = 20_000


def buckets_for(ids_a_day: int, bytes_an_id: int = 40) -> int:
    """The number of buckets for a log that grows by so many ids a day."""
    return max(1, min(MAX_BUCKETS, -(-ids_a_day * bytes_an_id // BUCKET_BYTES)))


def _day(ms):
    return F.floor(ms / DAY_MS).cast("int")


class SeenLog:
    """The log at ``path`` (a folder that driver and executors share).

    ``buckets`` counts for the first write only: later ones, of any session, keep what is stored."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        stored = fs.child_dirs(spark, f"{self.path}/_buckets")
        self.buckets = int(stored[0]) if stored else buckets
        if not stored:
            fs.mkdirs(spark, f"{self.path}/ids")
            fs.mkdirs(spark, f"{self.path}/_buckets/{self.buckets}")
        # The catalog's entry is found again by the path; its files stay when a session ends.
        self.table = f"seen_{hashlib.md5(self.path.encode()).hexdigest()}"
        spark.sql(f"""CREATE TABLE IF NOT EXISTS {self.table} (click_id STRING, seen_ms BIGINT, seen_day INT, batch_id BIGINT)
                      USING parquet PARTITIONED BY (seen_day, batch_id)
                      CLUSTERED BY (click_id) SORTED BY (click_id) INTO {self.buckets} BUCKETS
                      LOCATION '{self.path}/ids'""")
        spark.catalog.recoverPartitions(self.table)

    def _days(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in fs.child_dirs(self.spark, f"{self.path}/ids") if n.startswith("seen_day="))

    def _remove(self, day: int, batch_id: int | None = None) -> None:
        """A day's rows, or those of one batch, from the catalog and the folder."""
        part, folder = f"seen_day={day}", f"{self.path}/ids/seen_day={day}"
        if batch_id is not None:
            part, folder = f"{part}, batch_id={batch_id}", f"{folder}/batch_id={batch_id}"
        self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION ({part})")
        fs.delete(self.spark, folder)

    def append(self, passed: DataFrame, batch_id: int, key: str = "click_id", ts: str = "timestamp_ms") -> None:
        """Log a batch's passed ids; the shuffle by id gives each bucket and day one file."""
        rows = (passed.select(F.col(key).cast("string").alias("click_id"), F.col(ts).cast("long").alias("seen_ms"))
                      .dropna().withColumn("seen_day", _day(F.col("seen_ms"))).withColumn("batch_id", F.lit(batch_id).cast("long"))
                      .repartition(self.buckets, "click_id"))
        for day in self._days():  # what an earlier attempt of this batch left
            if fs.exists(self.spark, f"{self.path}/ids/seen_day={day}/batch_id={batch_id}"):
                self._remove(day, batch_id)
        rows.write.mode("append").insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def ids(self, first_ms: int | None = None, last_ms: int | None = None) -> DataFrame:
        """click_id, seen_ms of the sights from ``first_ms`` to ``last_ms``; other days are not read."""
        rows = self.spark.table(self.table)
        if first_ms is not None:
            rows = rows.filter((F.col("seen_day") >= first_ms // DAY_MS) & (F.col("seen_ms") >= first_ms))
        if last_ms is not None:
            rows = rows.filter((F.col("seen_day") <= last_ms // DAY_MS) & (F.col("seen_ms") <= last_ms))
        return rows.select("click_id", "seen_ms")

    def drop_seen(self, batch: DataFrame, ttl_ms: int = DAY_MS, key: str = "click_id",
                  batch_start: str = "batch_start_ms") -> DataFrame:
        """Rows of ``batch`` whose id the log does not hold within the period before the row's ``batch_start``."""
        span = batch.agg(F.min(batch_start), F.max(batch_start)).first()
        if span[0] is None:
            return batch
        seen = self.ids(span[0] - ttl_ms + 1, span[1] - 1)
        if key != "click_id":
            seen = seen.withColumnRenamed("click_id", key)
        return anti_join_seen_batches(batch.repartition(self.buckets, key), seen, ttl_ms, key, batch_start)

    def forget(self, before_ms: int) -> list[int]:
        """Remove whole days that end before ``before_ms``; returns them."""
        gone = [d for d in self._days() if (d + 1) * DAY_MS <= before_ms]
        for day in gone:
            self._remove(day)
        self.spark.catalog.refreshTable(self.table)
        return gone
