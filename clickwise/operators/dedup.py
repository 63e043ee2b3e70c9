"""First-sight de-duplication of click ids (DED-1, FLT-1, FLT-4, JN-3).

Semantics of the reference's idempotency key (set-if-absent with a TTL that a
repeat does not refresh): the first sight of an id passes and opens a TTL
period; every sight inside that period is a duplicate; the first sight at or
after its end passes again and opens the next period.

Batch plan: one aggregation per id (map-side combined, so a hot id costs one
buffer per task, not a shuffle of its rows) picks each id's first sight.  Ids
whose sights span a whole TTL period can pass again: their sights alone (id and
time) go through one round per period, checkpointed to the shared folder, and
the payload of those further passes is joined once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clickwise.session import ensure_checkpoint_dir

DAY_MS = 24 * 3600 * 1000


def _repeat_passes(events: DataFrame, key: str, ts: str, ttl_ms: int) -> DataFrame | None:
    """(key, pass time) of every pass after an id's first one, or None if there is none.

    Only ids whose sights span a whole period can pass again.  Their sights alone
    (id and time, no payload) go through one round per period; each round's rows
    are checkpointed."""
    span = (events.groupBy(key).agg(F.min(ts).alias("_pass"), F.max(ts).alias("_hi"))
                  .filter(F.col("_hi") >= F.col("_pass") + F.lit(ttl_ms)).select(key, "_pass"))
    ensure_checkpoint_dir(events.sparkSession)
    passes = span.checkpoint()
    found = None
    sights = events.select(key, ts)
    while not passes.isEmpty():
        sights = (sights.join(passes, key).filter(F.col(ts) >= F.col("_pass") + F.lit(ttl_ms)).select(key, ts).checkpoint())
        passes = sights.groupBy(key).agg(F.min(ts).alias("_pass")).checkpoint()
        if not passes.isEmpty():
            found = passes if found is None else found.unionByName(passes)
    return found


def first_sight(events: DataFrame, key: str = "click_id", ts: str = "timestamp_ms",
                ttl_ms: int = DAY_MS, tiebreak: tuple[str, ...] = ()) -> DataFrame:
    """Rows that pass the TTL dedup (one per id and period), all columns kept."""
    cols = events.columns
    order = F.struct(F.col(ts), *[F.col(c) for c in tiebreak]) if tiebreak else F.col(ts)

    def earliest(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(F.min_by(F.struct(*cols), order).alias("first")).select("first.*")

    first = earliest(events, key)
    again = _repeat_passes(events, key, ts, ttl_ms)
    if again is None:
        return first
    # The payload of the further passes is joined once, on id and time.
    later = events.join(again.select(F.col(key), F.col("_pass").alias(ts)), [key, ts], "left_semi").select(*cols)
    return first.unionByName(earliest(later, key, ts))


def dedup_counts(events: DataFrame, passed: DataFrame) -> DataFrame:
    """FLT-4: published (passed) and duplicate (dropped) counters, one row."""
    marks = (events.select(F.lit(1).alias("_seen"), F.lit(0).alias("_pub"))
             .unionByName(passed.select(F.lit(0).alias("_seen"), F.lit(1).alias("_pub"))))
    return marks.agg(F.sum("_pub").cast("long").alias("published"),
                     (F.sum("_seen") - F.sum("_pub")).cast("long").alias("duplicates"))


def anti_join_seen(batch: DataFrame, seen: DataFrame, now_ms: int, ttl_ms: int = DAY_MS,
                   key: str = "click_id", seen_ts: str = "seen_ms") -> DataFrame:
    """JN-3: drop ids already seen within the TTL before ``now_ms``.

    ``seen`` is the id log of earlier batches (key, seen_ms); the time filter
    prunes it before the anti-join, which shuffles both sides on the id (or
    broadcasts ``seen`` when Catalyst measures it small).
    """
    recent = seen.filter(F.col(seen_ts) > F.lit(now_ms - ttl_ms)).select(key)
    return batch.join(recent, key, "left_anti")


def anti_join_seen_batches(batch: DataFrame, seen: DataFrame, ttl_ms: int = DAY_MS, key: str = "click_id",
                           batch_start: str = "batch_start_ms", seen_ts: str = "seen_ms") -> DataFrame:
    """JN-3 for many batches at once: a row of the batch starting at
    ``batch_start`` is dropped when its id was seen in the TTL before that start.

    An equi-join on the id with a time-range residual: both sides shuffle on
    the id (or ``seen`` is broadcast when Catalyst measures it small).
    """
    s = seen.select(F.col(key).alias("_seen_key"), F.col(seen_ts).alias("_seen_ms"))
    cond = ((batch[key] == s["_seen_key"]) & (s["_seen_ms"] > batch[batch_start] - F.lit(ttl_ms))
            & (s["_seen_ms"] < batch[batch_start]))
    return batch.join(s, cond, "left_anti")
