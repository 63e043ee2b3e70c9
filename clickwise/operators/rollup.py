"""Hourly and daily rollups (AGG-8, AGG-9, AGG-10, AGG-12, STR-12).

Two ways to the same rows:

* ``hourly`` and ``daily`` sum the latest minute rows and the hourly rows;
* ``retract_and_add`` turns the changes of minute rows into *deltas*: what a new version
  says, less what the version it replaces said.  Deltas of a period and key are added up
  when they are read (``sum_collapse``), so a batch of changes costs what it touches,
  whatever the tables hold, and a window emitted again is still counted once.

``unique_sessions`` is the sum of the finer grain's values, as in the
reference (an over-count across minutes, T5); sketches of sessions are kept by hour and
united when they are read, over any range (``unique_sessions_est``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from clickwise.operators.storage import latest_wins, sum_collapse
from clickwise.schemas import GROUP_KEYS

ROLLUP_KEYS = ("advertiser_id", *GROUP_KEYS)


def _truncate_ms(col: str, unit: str, out: str):
    return F.unix_millis(F.date_trunc(unit, F.timestamp_millis(F.col(col)))).alias(out)


def hourly(minutes: DataFrame, start_col: str = "window_start_ms") -> DataFrame:
    """AGG-8 over minute rows (ms columns)."""
    x = minutes.select(_truncate_ms(start_col, "hour", "window_hour_ms"), *ROLLUP_KEYS,
                       "click_count", "unique_sessions")
    return sum_collapse(x, ["window_hour_ms", *ROLLUP_KEYS])


def daily(hours: DataFrame) -> DataFrame:
    """AGG-9 over hourly rows."""
    x = hours.select(_truncate_ms("window_hour_ms", "day", "window_day_ms"), *ROLLUP_KEYS,
                     "click_count", "unique_sessions")
    return sum_collapse(x, ["window_day_ms", *ROLLUP_KEYS])


def version_changes(log: DataFrame, key=("window_start_ms", *GROUP_KEYS), version=("batch_id", "emit_seq")) -> DataFrame:
    """Every stored version of a minute row beside the one it replaces (``old_*``, null for the first)."""
    before = Window.partitionBy(*key).orderBy(*version)  # a key's versions: as many as it was emitted
    return log.withColumns({f"old_{c}": F.lag(c).over(before) for c in ("advertiser_id", "click_count", "unique_sessions")})


def retract_and_add(changes: DataFrame, unit: str, out: str, by: tuple[str, ...] = (), sketch: str | None = None) -> DataFrame:
    """STR-12: per period and key (and ``by``) the new values of changed minute rows less the old
    ones.  ``changes`` has window_start_ms, the keys, the values and ``old_*`` values."""
    period = _truncate_ms("window_start_ms", unit, out)
    sketches = [F.col(sketch)] if sketch else []
    none = [F.lit(None).cast("binary").alias(sketch)] if sketch else []
    add = changes.select(period, *by, *ROLLUP_KEYS, "click_count", "unique_sessions", *sketches)
    retract = (changes.filter("old_advertiser_id IS NOT NULL")
               .select(period, *by, F.col("old_advertiser_id").alias("advertiser_id"), *GROUP_KEYS,
                       (-F.col("old_click_count")).alias("click_count"), (-F.col("old_unique_sessions")).alias("unique_sessions"), *none))
    sums = [F.sum(c).cast("long").alias(c) for c in ("click_count", "unique_sessions")]
    unions = [F.hll_union_agg(sketch).alias(sketch)] if sketch else []
    return add.unionByName(retract).groupBy(out, *by, *ROLLUP_KEYS).agg(*sums, *unions)


def rollups(log: DataFrame, mode: str = "latest"):
    """Hourly and daily tables from a versioned minute log, from the latest versions or, with
    ``deltas``, from each batch's changes."""
    if mode == "latest":
        minutes = latest_wins(log, key=("window_start_ms", *GROUP_KEYS))
        h = hourly(minutes)
        return h, daily(h)
    if mode == "deltas":
        changes = version_changes(log)
        return tuple(sum_collapse(retract_and_add(changes, unit, f"window_{unit}_ms", by=("batch_id",)), [f"window_{unit}_ms", *ROLLUP_KEYS])
                     for unit in ("hour", "day"))
    raise ValueError(f"unknown rollup mode {mode!r}")


def hourly_with_estimate(minutes_with_sketch: DataFrame, start_col: str = "window_start_ms") -> DataFrame:
    """AGG-8 and AGG-12 in one aggregation: summed counts (reference
    semantics) plus the united session sketch of the hour and its estimate."""
    x = minutes_with_sketch.select(_truncate_ms(start_col, "hour", "window_hour_ms"), *ROLLUP_KEYS,
                                   "click_count", "unique_sessions", "session_sketch")
    return (x.groupBy("window_hour_ms", *ROLLUP_KEYS)
             .agg(F.sum("click_count").cast("long").alias("click_count"),
                  F.sum("unique_sessions").cast("long").alias("unique_sessions"),
                  F.hll_union_agg("session_sketch").alias("session_sketch"))
             .withColumn("unique_sessions_est", F.hll_sketch_estimate("session_sketch"))
             .filter((F.col("click_count") != 0) | (F.col("unique_sessions") != 0)))


def merged_sessions(minutes_with_sketch: DataFrame, unit: str = "hour") -> DataFrame:
    """AGG-12: coarser-grain unique sessions from merged sketches (plus the
    reference's summed value for contrast)."""
    out = f"window_{unit}_ms"
    x = minutes_with_sketch.select(_truncate_ms("window_start_ms", unit, out), *ROLLUP_KEYS,
                                   "unique_sessions", "session_sketch")
    return (x.groupBy(out, *ROLLUP_KEYS)
             .agg(F.sum("unique_sessions").cast("long").alias("unique_sessions"),
                  F.hll_sketch_estimate(F.hll_union_agg("session_sketch")).alias("unique_sessions_est")))


def current_hours(rows: DataFrame, period: str = "window_hour") -> DataFrame:
    """AGG-10: the hourly rows in force out of deltas (``batch_id``, ``is_base``): the sums of each
    key's deltas and the union of their sketches.  A row with ``is_base`` replaces all of its hour
    and key that earlier batches wrote, whatever their advertiser (a sketch cannot be retracted)."""
    key = [period, *GROUP_KEYS]
    base = rows.filter("is_base").groupBy(*key).agg(F.max("batch_id").alias("_from"))
    live = rows.join(base, key, "left").filter("_from IS NULL OR batch_id >= _from")
    more = ["month"] if "month" in rows.columns else []
    return (live.groupBy(period, *ROLLUP_KEYS, *more)
                .agg(F.sum("click_count").cast("long").alias("click_count"), F.sum("unique_sessions").cast("long").alias("unique_sessions"),
                     F.hll_union_agg("session_sketch").alias("session_sketch"))
                .filter((F.col("click_count") != 0) | (F.col("unique_sessions") != 0)))


def current_days(rows: DataFrame, period: str = "window_day") -> DataFrame:
    """AGG-10: the daily rows in force, the sums of each key's deltas."""
    return sum_collapse(rows, [period, *ROLLUP_KEYS, *(["month"] if "month" in rows.columns else [])])
