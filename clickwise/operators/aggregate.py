"""Windowed click aggregation (AGG-1..AGG-6, PRJ-3/4/8, STR-4/8, UDX-1/2).

The reference's accumulator (id set, click counter, session HLL, metadata of
the first event) becomes a list of native aggregate Columns, so Catalyst plans
partial (map-side) and final aggregation and the state store holds the buffers
in streaming.  Keys are three columns, not a joined string (no ``|``
collisions).

Scale notes: the batch plan counts distinct click ids with Spark's
single-distinct rewrite, whose first exchange hashes on (window, keys,
click_id), so a hot ad is spread over all reducers; sketches merge in
constant space per key; the advertiser pick is an ordinary partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clickwise.functions.timefmt import event_time
from clickwise.schemas import GROUP_KEYS, UNKNOWN

# Fixed value: HLL precision of the reference's session sketch (2^14 registers).
HLL_PRECISION = 14


def normalize_keys(df: DataFrame) -> DataFrame:
    """PRJ-3: a null country or device becomes 'UNKNOWN' once, before grouping.

    An empty string is kept as is (the reference maps only null).
    """
    return (df.withColumn("country", F.coalesce(F.col("country"), F.lit(UNKNOWN)))
              .withColumn("device_type", F.coalesce(F.col("device_type"), F.lit(UNKNOWN))))


def advertiser_pick() -> Column:
    """AGG-3: advertiser of the earliest event (ties by click id) — deterministic."""
    return F.min_by("advertiser_id", F.struct("timestamp_ms", "click_id")).alias("advertiser_id")


def session_sketch(precision: int = HLL_PRECISION) -> Column:
    """AGG-2 state: HLL sketch of session ids; null sessions are skipped (FLT-2)."""
    return F.hll_sketch_agg("session_id", precision).alias("session_sketch")


def batch_aggregates(exact_sessions: bool = False, with_sketch: bool = False,
                     precision: int = HLL_PRECISION) -> list[Column]:
    """UDX-1 for batch input: distinct clicks, sessions, advertiser pick."""
    aggs = [F.count_distinct("click_id").alias("click_count"), advertiser_pick()]
    if exact_sessions:
        aggs.append(F.count_distinct("session_id").alias("unique_sessions"))
    if with_sketch or not exact_sessions:
        aggs.append(session_sketch(precision))
    return aggs


def with_window_columns(df: DataFrame) -> DataFrame:
    """PRJ-8 / UDX-2: stamp window start/end (timestamp and epoch ms)."""
    return (df.withColumn("window_start", F.col("window.start"))
              .withColumn("window_end", F.col("window.end"))
              .withColumn("window_start_ms", F.unix_millis("window.start"))
              .withColumn("window_end_ms", F.unix_millis("window.end"))
              .drop("window"))


def finish(df: DataFrame, exact_sessions: bool) -> DataFrame:
    """AGG-4: final projection; the sketch estimate becomes ``unique_sessions``."""
    if not exact_sessions:
        df = df.withColumn("unique_sessions", F.hll_sketch_estimate("session_sketch"))
    return df


def window_aggregate(clicks: DataFrame, window: str = "1 minute", exact_sessions: bool = False,
                     with_sketch: bool = False, keys=GROUP_KEYS,
                     precision: int = HLL_PRECISION) -> DataFrame:
    """STR-4/STR-8 batch form: tumbling, epoch-aligned event-time windows.

    Output: window_start, window_end, window_start_ms, window_end_ms, keys,
    advertiser_id, click_count, unique_sessions [, session_sketch].

    With exact sessions, two distinct counts plus the advertiser pick would
    make Spark expand every row three times into one sort-based aggregate.
    Instead: distinct clicks (with their earliest event) from an aggregate on
    (window, keys, click_id) and distinct sessions from a hash aggregate are
    unioned and summed per (window, keys) — half the work, same answer.
    """
    df = normalize_keys(clicks).withColumn("window", F.window(event_time("timestamp_ms"), window))
    k = ["window", *keys]
    if exact_sessions:
        first = F.min(F.struct("timestamp_ms", "click_id", "advertiser_id")).alias("_first")
        ids = df.groupBy(*k, "click_id").agg(first)
        none_first = F.lit(None).cast(ids.schema["_first"].dataType)
        ids = ids.select(*k, "_first", F.lit(None).cast("string").alias("session_id"),
                         F.lit(1).alias("_c"), F.lit(0).alias("_s"))
        sessions = (df.filter(F.col("session_id").isNotNull()).select(*k, "session_id").distinct()
                      .select(*k, none_first.alias("_first"), "session_id", F.lit(0).alias("_c"),
                              F.lit(1).alias("_s")))
        aggs = [F.sum("_c").cast("long").alias("click_count"),
                F.sum("_s").cast("long").alias("unique_sessions"),
                F.min("_first")["advertiser_id"].alias("advertiser_id")]
        if with_sketch:
            aggs.append(session_sketch(precision))
        out = ids.unionByName(sessions).groupBy(*k).agg(*aggs)
    else:
        out = df.groupBy(*k).agg(*batch_aggregates(False, with_sketch, precision))
    out = finish(with_window_columns(out), exact_sessions)
    if not with_sketch and "session_sketch" in out.columns:
        out = out.drop("session_sketch")
    return out


# ------------------------------------------------------------ partials ----

def partial_states(clicks: DataFrame, window: str = "1 minute", by=("part",),
                   precision: int = HLL_PRECISION):
    """AGG-5 inputs: per (partial, window, key) the seen id set and the session sketch.

    The id set is kept exploded — one row per (partial, window, key, click_id) —
    so no single row ever holds an unbounded array.
    """
    df = normalize_keys(clicks).withColumn("event_time", event_time("timestamp_ms"))
    df = df.withColumn("window_start", F.window("event_time", window).start)
    keys = [*by, "window_start", *GROUP_KEYS]
    ids = df.select(*keys, "click_id").distinct()
    sketches = df.groupBy(*keys).agg(
        session_sketch(precision),
        F.min(F.struct("timestamp_ms", "click_id", "advertiser_id")).alias("first_event"))
    return ids, sketches


def merge_partials(ids: DataFrame, sketches: DataFrame, window_col: str = "window_start") -> DataFrame:
    """AGG-5: set union re-counted, sketch union, first metadata by time.

    The id rows of all partials are made distinct (shuffled on (window, key,
    click_id), so a hot key never gathers its ids in one buffer), unioned
    with the sketch rows and finished in one aggregation per (window, key):
    the count of distinct ids, the union of sketches and the earliest event."""
    keys = [window_col, *GROUP_KEYS]
    first_type = sketches.schema["first_event"].dataType
    id_rows = ids.select(*keys, "click_id").distinct().select(
        *keys, F.lit(1).alias("_c"), F.lit(None).cast("binary").alias("session_sketch"),
        F.lit(None).cast(first_type).alias("first_event"))
    sketch_rows = sketches.select(*keys, F.lit(0).alias("_c"), "session_sketch", "first_event")
    merged = id_rows.unionByName(sketch_rows).groupBy(*keys).agg(
        F.sum("_c").cast("long").alias("click_count"),
        F.hll_union_agg("session_sketch").alias("session_sketch"),
        F.min("first_event")["advertiser_id"].alias("advertiser_id"))
    return merged.withColumn("unique_sessions", F.hll_sketch_estimate("session_sketch"))
