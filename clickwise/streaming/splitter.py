"""Q2: split each micro-batch into accepted and late rows (STR-2, STR-5, STR-6).

Spark drops late rows silently and with the previous batch's watermark (T2),
so the late side output is built explicitly.  For micro-batch ``b``:

1. read the watermark ledger written by batch ``b-1``: per source partition
   the max event time seen and the processing time it was last active, and the
   highest watermark so far;
2. watermark = the greater of that highest one and the min over partitions active
   within the idle timeout of (their max) - delay, so it never falls: a partition
   that was idle and comes back does not reopen what was closed meanwhile; no
   ledger yet means no watermark;
3. T1 splits the batch: late iff window end + lateness <= watermark;
4. accepted rows, late rows and late text are written under ``batch_id=b``
   with overwrite, then the cumulative ledger row set for ``b``.

Step 3 depends only on the batch rows and ledger ``b-1``, so re-running a
batch after a failure rewrites the same rows.  The ledger has one row per
source partition (a bounded, small table), the only thing the driver reads.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from clickwise.config import JobConfig
from clickwise.functions.timefmt import late_text
from clickwise.operators.lateness import is_late, window_end_ms
from clickwise.sinks.messages import kafka_available, late_messages, write_messages
from clickwise.sources import fs


LEDGER_SCHEMA = T.StructType([T.StructField("part", T.LongType()),
                             T.StructField("max_event_ms", T.LongType()),
                             T.StructField("last_active_ms", T.LongType()),
                             # The highest watermark so far, the same on every row.
                             T.StructField("watermark_ms", T.LongType())])


def next_watermark(ledger: dict, highest: int | None, cfg: JobConfig) -> int | None:
    """The watermark after ``ledger`` (partition -> max event time, last active), never below ``highest``."""
    if not ledger:
        return highest
    newest = max(active for _, active in ledger.values())
    idle_ms = cfg.idle_partition_minutes * 60_000
    now = min(m for m, active in ledger.values() if active >= newest - idle_ms) - cfg.watermark_seconds * 1000
    return now if highest is None else max(highest, now)


class LateSplitter:
    """A ``foreachBatch`` function.  Outputs under ``base``: late/, late_text/,
    ledger/ and, with ``keep_accepted``, accepted/ — each by ``batch_id``; only the
    last two ledgers are kept.  ``tables`` is called with the accepted rows."""

    def __init__(self, base: str, cfg: JobConfig = JobConfig(), part_col: str | None = None,
                 clock=lambda: int(time.time() * 1000), keep_accepted: bool = True,
                 late_topic_servers: str | None = None, tables=None):
        self.base = base.rstrip("/")
        self.cfg = cfg
        self.part_col = part_col
        self.clock = clock
        self.keep_accepted = keep_accepted
        self.late_topic_servers = late_topic_servers
        self.tables = tables

    def path(self, name: str, batch_id: int | None = None) -> str:
        p = f"{self.base}/{name}"
        return p if batch_id is None else f"{p}/batch_id={batch_id}"

    def watermark_ms(self, spark: SparkSession, batch_id: int):
        """Watermark in force for ``batch_id`` (None before any data)."""
        prev = self.path("ledger", batch_id - 1)
        if batch_id == 0 or not fs.child_dirs(spark, self.path("ledger")):
            return None
        if not fs.exists(spark, prev):
            raise FileNotFoundError(f"{prev} is gone: only the last batch can be replayed")
        return self._ledger(spark, batch_id - 1)[1]

    def _ledger(self, spark: SparkSession, batch_id: int) -> tuple[dict, int | None]:
        """Ledger of a batch (one row per source partition) and the highest watermark with it."""
        path = self.path("ledger", batch_id)
        if batch_id < 0 or not fs.exists(spark, path):
            return {}, None
        rows = spark.read.schema(LEDGER_SCHEMA).parquet(path).collect()
        led = {r["part"]: (r["max_event_ms"], r["last_active_ms"]) for r in rows}
        # A ledger of an earlier release has no watermark of its own.
        stored = [r["watermark_ms"] for r in rows if r["watermark_ms"] is not None]
        return led, max(stored) if stored else next_watermark(led, None, self.cfg)

    def split(self, batch: DataFrame, wm) -> DataFrame:
        w_ms = self.cfg.window_minutes * 60_000
        wm_col = F.lit(wm).cast("long")
        return (batch.withColumn("window_end_ms", window_end_ms(F.col("timestamp_ms"), w_ms))
                     .withColumn("is_late", is_late(F.col("timestamp_ms"), wm_col, w_ms,
                                                    self.cfg.allowed_lateness_seconds * 1000)))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        wm = self.watermark_ms(spark, batch_id)
        part = F.col(self.part_col) if self.part_col else F.lit(0)
        x = self.split(batch.withColumn("_part", part), wm).persist()
        try:
            # One small aggregate gives both this batch's ledger contribution
            # and its late-row count (one row per source partition).
            stats = x.groupBy(F.col("_part").alias("part")).agg(
                F.max("timestamp_ms").alias("max_event_ms"),
                F.sum(F.col("is_late").cast("long")).alias("_late")).collect()
            cols = list(batch.columns)
            accepted = x.filter(~F.col("is_late")).select(*cols)
            if self.keep_accepted:
                accepted.write.mode("overwrite").parquet(self.path("accepted", batch_id))
            if any(r["_late"] for r in stats):
                late = x.filter(F.col("is_late"))
                late.select(*cols, "window_end_ms", F.lit(wm).cast("long").alias("watermark_ms")) \
                    .write.mode("overwrite").parquet(self.path("late", batch_id))
                late.select(late_text("click_id", "ad_id").alias("value")) \
                    .write.mode("overwrite").text(self.path("late_text", batch_id))
                if self.late_topic_servers:
                    # SNK-2: the same records to the late topic (at-least-once on replay)
                    write_messages(late_messages(late), self.cfg.late_clicks_topic, self.late_topic_servers, None)
            if self.tables:
                self.tables(accepted, batch_id, wm)
            self._write_ledger(spark, stats, batch_id)
        finally:
            x.unpersist()

    def _write_ledger(self, spark: SparkSession, stats, batch_id: int) -> None:
        """Cumulative ledger for ``batch_id``: per source partition the max
        event time so far and when it was last active (a few rows)."""
        now = self.clock()
        led, highest = self._ledger(spark, batch_id - 1)
        for r in stats:
            old = led.get(r["part"])
            led[r["part"]] = (max(r["max_event_ms"], old[0]) if old else r["max_event_ms"], now)
        wm = next_watermark(led, highest, self.cfg)
        rows = [(p, m, a, wm) for p, (m, a) in sorted(led.items())]
        spark.createDataFrame(rows, LEDGER_SCHEMA).coalesce(1) \
             .write.mode("overwrite").parquet(self.path("ledger", batch_id))
        # A replay of this batch needs the ledger before it; no older one is read again.
        if batch_id >= 2:
            fs.delete(spark, self.path("ledger", batch_id - 2))


def current_watermark_ms(spark: SparkSession, base: str, cfg: JobConfig = JobConfig()):
    """The watermark the splitter would apply to its next batch (None before data)."""
    last = max((int(n.split("=")[1]) for n in fs.child_dirs(spark, f"{base.rstrip('/')}/ledger")), default=None)
    return None if last is None else LateSplitter(base, cfg).watermark_ms(spark, last + 1)


def start_splitter(events: DataFrame, base: str, checkpoint: str, cfg: JobConfig = JobConfig(),
                   part_col: str | None = None, trigger: dict | None = None, keep_accepted: bool = True,
                   late_topic_servers: str | None = None, tables=None):
    """Start Q2.  The watermark follows the source partitions where the stream names
    them (``source_partition``, as read from the topic), else ``part_col``."""
    if late_topic_servers and not kafka_available(events.sparkSession):
        raise RuntimeError("a late topic is configured, but the Kafka package is not on the class path")
    if part_col is None and "source_partition" in events.columns:
        part_col = "source_partition"
    splitter = LateSplitter(base, cfg, part_col, keep_accepted=keep_accepted, late_topic_servers=late_topic_servers, tables=tables)
    w = events.writeStream.foreachBatch(splitter).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": f"{cfg.trigger_seconds} seconds"})).start()
