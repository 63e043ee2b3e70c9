"""When a window closes and when a record is late (T1, STR-6, STR-7).

With ``wm = max event time seen so far - watermark delay``:

* a window ``[start, end)`` is closed once ``end <= wm``;
* a record is late (rejected, goes to the late output) once
  ``end + allowed_lateness <= wm`` for its window.

The same predicate serves the streaming splitter and the batch audit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Reference defaults (watermark 10 s, lateness 30 s, 1-minute windows).
WATERMARK_MS = 10_000
LATENESS_MS = 30_000
WINDOW_MS = 60_000


def window_end_ms(ts_ms: Column, window_ms: int) -> Column:
    return (F.floor(ts_ms / F.lit(window_ms)) * window_ms + window_ms).cast("long")


def is_late(ts_ms: Column, watermark_ms: Column, window_ms: int = WINDOW_MS,
            lateness_ms: int = LATENESS_MS) -> Column:
    """T1: late iff window end + allowed lateness <= watermark (null watermark: not late)."""
    return F.coalesce(window_end_ms(ts_ms, window_ms) + lateness_ms <= watermark_ms, F.lit(False))


def is_closed(window_end: Column, watermark_ms: Column) -> Column:
    return F.coalesce(window_end <= watermark_ms, F.lit(False))


def _prefix_max(chunks: DataFrame, cols: list[str], per_group: int = 4096) -> DataFrame:
    """Exclusive running max of ``cols`` over ``_chunk``, in two levels: over the
    chunks of a group, and over the groups' maxima, so that no window grows with
    the number of chunks alone."""
    x = chunks.withColumn("_group", F.floor(F.col("_chunk") / per_group))
    groups = x.groupBy("_group").agg(*[F.max(c).alias(c) for c in cols])
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    up = groups.select("_group", *[F.max(c).over(before).alias(f"_g_{c}") for c in cols])
    inside = Window.partitionBy("_group").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return x.join(up, "_group").select("_chunk", *[F.greatest(F.col(f"_g_{c}"), F.max(c).over(inside)).alias(c) for c in cols])


# Fixed value: the reference's idle timeout of a source partition (5 minutes).
IDLE_MS = 300_000


def _running_max(rows: DataFrame, cols: list[str], order: list[str], inclusive: bool) -> DataFrame:
    """``rows`` (with ``_chunk``) plus ``_r_<col>``: the max of each column over the rows
    before, or up to, each one in ``order``.  A prefix over chunks, then one inside a chunk."""
    prefix = _prefix_max(rows.groupBy("_chunk").agg(*[F.max(c).alias(c) for c in cols]), cols)
    inside = Window.partitionBy("_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    prefix = prefix.withColumnsRenamed({c: f"_p{c}" for c in cols})
    out = rows.withColumns({f"_i{c}": F.max(c).over(inside) for c in cols}).join(prefix, "_chunk", "left")
    return (out.withColumns({f"_r{c}": F.greatest(F.col(f"_p{c}"), F.col(f"_i{c}")) for c in cols})
               .drop(*[f"_p{c}" for c in cols], *[f"_i{c}" for c in cols]))


def lateness_audit(arrivals: DataFrame, n_parts: int, window_ms: int = WINDOW_MS, watermark_delay_ms: int = WATERMARK_MS,
                   lateness_ms: int = LATENESS_MS, part: str = "part", seq: str = "seq",
                   tiebreak: str = "event_id", ts: str = "timestamp_ms",
                   chunk: int = 1 << 16, arrived: str | None = None, idle_ms: int = IDLE_MS) -> DataFrame:
    """STR-7: replay the arrival order and mark each record late or not.

    As in the stream, the watermark a record meets never falls: it is the highest value,
    over all arrivals before it, of the minimum over the source partitions
    (0 .. n_parts - 1) that have sent something of their max event time, minus the
    delay.  With ``arrived`` (processing time in ms, not falling along ``seq``) a
    partition that was silent for longer than ``idle_ms`` leaves the minimum until it
    sends again; without it no partition ever idles.

    Running maxima are prefix scans over chunks of ``chunk`` arrivals: maxima per chunk,
    their exclusive prefix, and the running max inside a chunk, once for the
    partitions' maxima and once for the watermark.  No window holds more than a
    chunk's rows.
    """
    order = [seq, tiebreak, part]
    seen = [f"_m{p}" for p in range(n_parts)]
    active = [f"_a{p}" for p in range(n_parts)] if arrived else []
    x = arrivals.withColumn("_chunk", F.floor(F.col(seq) / F.lit(chunk)).cast("long"))
    x = x.withColumns({c: F.when(F.col(part) == p, F.col(ts)) for p, c in enumerate(seen)}
                      | {c: F.when(F.col(part) == p, F.col(arrived)) for p, c in enumerate(active)})
    x = _running_max(x, seen + active, order, inclusive=False)
    least = lambda cols: F.least(*cols) if len(cols) > 1 else cols[0]
    if arrived:
        last = [F.col(f"_r{c}") for c in active]
        newest = F.greatest(*last) if n_parts > 1 else last[0]
        low = least([F.when(a >= newest - F.lit(idle_ms), F.col(f"_r{c}")) for a, c in zip(last, seen)])
    else:
        low = least([F.col(f"_r{c}") for c in seen])
    own = seen + active + [f"_r{c}" for c in seen + active]
    y = _running_max(x.withColumn("_low", low).drop(*own), ["_low"], order, inclusive=True)
    y = y.withColumnRenamed("_r_low", "max_before_ms")
    wm = F.col("max_before_ms") - F.lit(watermark_delay_ms)
    return (y.withColumn("watermark_ms", wm)
             .withColumn("window_end_ms", window_end_ms(F.col(ts), window_ms))
             .withColumn("is_late", is_late(F.col(ts), wm, window_ms, lateness_ms))
             .drop("_chunk", "_low"))
