"""Minute tables of accepted clicks, with rollups by difference
(STR-4, STR-5, STR-8, STR-10, STR-12, SNK-1, SNK-5, SNK-6, AGG-5, AGG-10, AGG-11).

``MinuteTables`` is called by the late splitter with each micro-batch's
accepted rows; there is no second watermark, so every accepted click counts.
Tables under ``base``, all in folders of their batch (``sinks.batches``):

* ``_partials/``     per batch and (window, key): the ids seen and a session sketch
  (``_spans`` names the hours of each batch);
* ``clicks_1min/``   a new version of every minute row the batch touched;
* ``clicks_hourly/`` what the batch adds to and takes from hours (deltas, session sketches);
* ``clicks_daily/``  what it adds to and takes from days.

A batch reads the partials of the windows it touched, no stored table: these give each
touched row's value with and without the batch, and the difference goes to the rollups.
So its cost follows its own windows, not what the month holds.  Where a late click
changes the advertiser of a minute, the hour's rows of that key are written anew
from the hour's partials and replace the earlier ones (``is_base``): sketches cannot be
retracted.

A batch's rows depend on the partials of batches up to it alone, so a replayed batch
rewrites the same rows.  A batch becomes visible at once, when its commit marker is there.
``compact_tables`` merges the folders of many batches while the stream runs.  A batch's
partials are deleted once the watermark has closed all its hours for good; a click of a
closed hour is refused, not counted from nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clickwise.config import JobConfig
from clickwise.functions.timefmt import to_yyyymm
from clickwise.operators import rollup
from clickwise.operators.aggregate import normalize_keys, session_sketch
from clickwise.operators.lateness import is_closed
from clickwise.operators.storage import latest_wins
from clickwise.schemas import GROUP_KEYS
from clickwise.sinks import batches
from clickwise.sinks.batches import commit, committed_batch, read_batches  # noqa: F401
from clickwise.sinks.tables import write_sorted
from clickwise.sources import fs

HOUR_MS = 3_600_000
WINDOW_KEY = ("hour", "window_start_ms", *GROUP_KEYS)
MINUTE_VALUES = ("window_end", "advertiser_id", "click_count", "unique_sessions", "session_sketch")


def _hour(ms: Column) -> Column:
    return F.floor(ms / HOUR_MS).cast("long")


class MinuteTables:
    def __init__(self, base: str, cfg: JobConfig = JobConfig(), jdbc: dict | None = None):
        self.base = base.rstrip("/")
        self.cfg = cfg
        self.jdbc = jdbc

    def _windowed(self, accepted: DataFrame) -> DataFrame:
        w_ms = self.cfg.window_minutes * 60_000
        start = (F.floor(F.col("timestamp_ms") / w_ms) * w_ms).cast("long")
        return normalize_keys(accepted).withColumn("window_start_ms", start).withColumn("hour", _hour(F.col("window_start_ms")))

    def _partials(self, accepted: DataFrame, batch_id: int) -> None:
        x = self._windowed(accepted)
        parts = {"ids": x.select(*WINDOW_KEY, "click_id").distinct(),
                 "sketches": x.groupBy(*WINDOW_KEY).agg(
                     session_sketch(self.cfg.hll_precision),
                     F.min(F.struct("timestamp_ms", "click_id", "advertiser_id")).alias("first_event"))}
        for name, df in parts.items():
            # Ranges of windows: few files however many hours the batch spans, a hot window in
            # many of them, and a later batch's filter skips those of other windows.
            order = [*WINDOW_KEY, *["click_id"] * (name == "ids")]
            (df.repartitionByRange(*order).sortWithinPartitions(*order)
               .write.mode("overwrite").parquet(f"{self.base}/_partials/{name}/batch_id={batch_id}"))

    def _spans(self, spark: SparkSession) -> list[tuple[int, int, int]]:
        """(batch, first hour, last hour) of the batches whose partials are kept."""
        return [tuple(map(int, n.split("_"))) for n in fs.child_dirs(spark, f"{self.base}/_spans")]

    def _partial_rows(self, spark: SparkSession, name: str, batch_id: int, hours: list[int], where: Column) -> DataFrame:
        """Partials of the batches up to this one that have rows of ``hours``; other batches' folders are not opened."""
        near = [b for b, lo, hi in self._spans(spark) if b <= batch_id and lo <= max(hours) and hi >= min(hours)]
        rows = read_batches(spark, self.base, f"_partials/{name}", batch_id, where, near)
        return rows.filter(F.col("hour").isin(hours))

    def _merged(self, spark: SparkSession, batch_id: int, hours: list[int], where: Column, only: DataFrame, on: list[str]) -> DataFrame:
        """The minute rows of ``only`` (joined by ``on``) from the partials: their values, and those
        without this batch as ``old_*`` (null where it is the first).  A set union of ids counted in
        two steps, a sketch union, the earliest event: one aggregation over both kinds of partials."""
        ids, sketches = (self._partial_rows(spark, n, batch_id, hours, where).join(only, on, "left_semi") for n in ("ids", "sketches"))
        keys = list(WINDOW_KEY)
        earlier = F.col("batch_id") < batch_id
        first_type = sketches.schema["first_event"].dataType
        id_rows = (ids.groupBy(*keys, "click_id").agg(F.min("batch_id").alias("batch_id"))
                      .select(*keys, "batch_id", F.lit(1).alias("_c"), F.lit(None).cast("binary").alias("session_sketch"),
                              F.lit(None).cast(first_type).alias("first_event")))
        rows = id_rows.unionByName(sketches.select(*keys, "batch_id", F.lit(0).alias("_c"), "session_sketch", "first_event"))
        out = rows.groupBy(*keys).agg(
            F.sum("_c").cast("long").alias("click_count"),
            F.sum(F.when(earlier, F.col("_c"))).cast("long").alias("old_click_count"),
            F.hll_union_agg("session_sketch").alias("session_sketch"),
            F.hll_union_agg(F.when(earlier, F.col("session_sketch"))).alias("_old_sketch"),
            F.min("first_event")["advertiser_id"].alias("advertiser_id"),
            F.min(F.when(earlier, F.col("first_event")))["advertiser_id"].alias("old_advertiser_id"))
        return (out.withColumn("unique_sessions", F.hll_sketch_estimate("session_sketch"))
                   .withColumn("old_unique_sessions", F.when(F.col("old_advertiser_id").isNotNull(), F.hll_sketch_estimate("_old_sketch")))
                   .drop("_old_sketch"))

    def _minute_rows(self, changes: DataFrame, batch_id: int) -> DataFrame:
        start = F.timestamp_millis("window_start_ms")
        return changes.select(start.alias("window_start"),
                              F.timestamp_millis(F.col("window_start_ms") + self.cfg.window_minutes * 60_000).alias("window_end"),
                              *GROUP_KEYS, "advertiser_id", "click_count", "unique_sessions", "session_sketch",
                              F.lit(0).cast("long").alias("emit_seq"), to_yyyymm(start).alias("month"),
                              F.lit(batch_id).cast("long").alias("batch_id"))

    def _write(self, df: DataFrame, name: str, period_col: str, batch_id: int) -> None:
        rows = (df.withColumn(period_col, F.timestamp_millis(f"{period_col}_ms")).drop(f"{period_col}_ms")
                  .withColumn("month", to_yyyymm(F.col(period_col))).withColumn("batch_id", F.lit(batch_id).cast("long")))
        write_sorted(rows, f"{self.base}/{name}", period_col, "month", "batch_id")

    def _rollups(self, spark: SparkSession, changes: DataFrame, batch_id: int, hours_touched: list[int]) -> None:
        hours = rollup.retract_and_add(changes, "hour", "window_hour_ms", sketch="session_sketch").withColumn("is_base", F.lit(False))
        moved = changes.filter("old_advertiser_id != advertiser_id").select("hour", *GROUP_KEYS).distinct()
        if not moved.isEmpty():  # a late click came first in its minute and names another advertiser
            whole = self._merged(spark, batch_id, hours_touched, F.lit(True), moved, ["hour", *GROUP_KEYS])
            anew = rollup.hourly_with_estimate(whole).drop("unique_sessions_est").withColumn("is_base", F.lit(True))
            gone = moved.select((F.col("hour") * HOUR_MS).alias("window_hour_ms"), *GROUP_KEYS)
            hours = hours.join(gone, ["window_hour_ms", *GROUP_KEYS], "left_anti").unionByName(anew)
        self._write(hours, "clicks_hourly", "window_hour", batch_id)
        self._write(rollup.retract_and_add(changes, "day", "window_day_ms"), "clicks_daily", "window_day", batch_id)

    def __call__(self, accepted: DataFrame, batch_id: int, watermark_ms: int | None = None) -> None:
        spark = accepted.sparkSession
        touched = self._windowed(accepted).select(*WINDOW_KEY).distinct().persist()
        try:
            hours = [r["hour"] for r in touched.select("hour").distinct().collect()]  # the hours of one micro-batch
            if hours:
                closed = max((int(n) for n in fs.child_dirs(spark, f"{self.base}/_closed")), default=None)
                if closed is not None and min(hours) <= closed:
                    raise ValueError(f"batch {batch_id} has clicks of hour {min(hours)}, whose partial states are gone (closed up to {closed})")
                self._partials(accepted, batch_id)
                fs.mkdirs(spark, f"{self.base}/_spans/{batch_id}_{min(hours)}_{max(hours)}")
                windows = touched.agg(F.min("window_start_ms"), F.max("window_start_ms")).first()
                changes = self._merged(spark, batch_id, hours, F.col("window_start_ms").between(*windows), touched, list(WINDOW_KEY)).persist()
                try:
                    minutes = self._minute_rows(changes, batch_id)
                    write_sorted(minutes, f"{self.base}/clicks_1min", "window_start", "month", "batch_id")
                    if self.jdbc:
                        from clickwise.sinks.jdbc import write_jdbc
                        write_jdbc(minutes, **self.jdbc)
                    self._rollups(spark, changes, batch_id, hours)
                finally:
                    changes.unpersist()
        finally:
            touched.unpersist()
        commit(spark, self.base, batch_id)
        if watermark_ms is not None:
            self._forget(spark, watermark_ms)

    def _forget(self, spark: SparkSession, watermark_ms: int) -> None:
        """Delete the partials of hours that no accepted click can reach any more."""
        safe = watermark_ms - self.cfg.allowed_lateness_seconds * 1000 - self.cfg.window_minutes * 60_000
        last = safe // HOUR_MS - 1  # the last hour that ends by then
        old = [int(n) for n in fs.child_dirs(spark, f"{self.base}/_closed")]
        if old and max(old) >= last:
            return
        fs.mkdirs(spark, f"{self.base}/_closed/{last}")
        for n in old:
            fs.delete(spark, f"{self.base}/_closed/{n}")
        for b, lo, hi in self._spans(spark):
            if hi <= last:
                for name in ("ids", "sketches"):
                    fs.delete(spark, f"{self.base}/_partials/{name}/batch_id={b}")
                fs.delete(spark, f"{self.base}/_spans/{b}_{lo}_{hi}")


def _union_partials(rows: DataFrame) -> DataFrame:
    """One partial per window and key in place of one per batch."""
    if "click_id" in rows.columns:
        return rows.select(*WINDOW_KEY, "click_id").distinct()
    return rows.groupBy(*WINDOW_KEY).agg(F.hll_union_agg("session_sketch").alias("session_sketch"), F.min("first_event").alias("first_event"))


def _write_by_window(rows: DataFrame, path: str) -> None:
    order = [*WINDOW_KEY, *["click_id"] * ("click_id" in rows.columns)]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def current_minutes(rows: DataFrame) -> DataFrame:
    return latest_wins(rows, key=("window_start", *GROUP_KEYS, *(["month"] if "month" in rows.columns else [])), values=MINUTE_VALUES)


# Table -> what its rows come down to, and how they are written.
COMPACTED = {
    "clicks_1min": (current_minutes, lambda df, path: write_sorted(df, path, "window_start", "month")),
    "clicks_hourly": (lambda df: rollup.current_hours(df).withColumn("is_base", F.lit(False)), lambda df, path: write_sorted(df, path, "window_hour", "month")),
    "clicks_daily": (rollup.current_days, lambda df, path: write_sorted(df, path, "window_day", "month")),
    "_partials/ids": (_union_partials, _write_by_window),
    "_partials/sketches": (_union_partials, _write_by_window),
}


def compact_tables(spark: SparkSession, base: str, names=tuple(COMPACTED)) -> dict[str, int | None]:
    """AGG-11: compact the job's tables up to the last committed batch; safe beside the running
    stream.  Partials of closed hours go with it.  Returns the batch each table is compacted to
    (None: nothing to do)."""
    closed = max((int(n) for n in fs.child_dirs(spark, f"{base.rstrip('/')}/_closed")), default=None)

    def resolve(name):
        rule = COMPACTED[name][0]
        if closed is None or not name.startswith("_partials/"):
            return rule
        return lambda df: rule(df.filter(F.col("hour") > closed))
    return {name: batches.compact(spark, base, name, resolve(name), COMPACTED[name][1]) for name in names}


def _empty(spark: SparkSession, base: str, name: str) -> DataFrame:
    raise FileNotFoundError(f"no batch of {name} is complete under {base}")


def read_minutes(spark: SparkSession, base: str, final_only_wm_ms: int | None = None) -> DataFrame:
    """Latest-wins minute rows; optionally only windows closed by a watermark."""
    rows = read_batches(spark, base, "clicks_1min")
    out = current_minutes(_empty(spark, base, "clicks_1min") if rows is None else rows.drop("month"))
    if final_only_wm_ms is not None:
        out = out.filter(is_closed(F.unix_millis("window_end"), F.lit(final_only_wm_ms)))
    return out


def read_final_minutes(spark: SparkSession, tables_base: str, split_base: str, cfg: JobConfig = JobConfig()) -> DataFrame:
    """Only windows already closed by the splitter's watermark (the values the
    reference emits at window close); provisional rows of open windows are left out."""
    from clickwise.streaming.splitter import current_watermark_ms
    wm = current_watermark_ms(spark, split_base, cfg)
    return read_minutes(spark, tables_base, final_only_wm_ms=-(1 << 62) if wm is None else wm)


def read_rollup(spark: SparkSession, base: str, grain: str = "hourly") -> DataFrame:
    """The current hourly rows, with the sessions' sketch and its estimate, or the daily ones."""
    rows = read_batches(spark, base, f"clicks_{grain}")
    rows = _empty(spark, base, f"clicks_{grain}") if rows is None else rows
    if grain == "hourly":
        return rollup.current_hours(rows).drop("month").withColumn("unique_sessions_est", F.hll_sketch_estimate("session_sketch"))
    return rollup.current_days(rows).drop("month")
