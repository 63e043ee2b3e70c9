"""Dedup TTL chains and the chunked lateness scan against brute force."""

import random

from pyspark.sql import functions as F

from clickwise.operators import dedup, lateness
from clickwise.sources import derived
from tests.conftest import SF01

DAY = dedup.DAY_MS


def brute_ttl(rows, ttl):
    """Set-if-absent with a TTL a repeat does not refresh, in arrival (time) order."""
    expires, kept = {}, []
    for cid, ts, eid in sorted(rows, key=lambda r: (r[1], r[2])):
        if cid in expires and ts < expires[cid]:
            continue
        expires[cid] = ts + ttl
        kept.append((cid, ts, eid))
    return sorted(kept)


def test_first_sight_chains_match_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    eid = 0
    for k in range(40):
        t = rnd.randrange(0, 3 * DAY)
        for _ in range(rnd.randrange(1, 12)):
            rows.append((f"id-{k % 25}", t, eid))     # ids recur, spanning several TTL periods
            eid += 1
            t += rnd.choice([0, 1000, 3_600_000, DAY // 2, DAY - 1, DAY, 2 * DAY])
    df = spark.createDataFrame(rows, "click_id string, timestamp_ms long, event_id long")
    got = sorted(tuple(r) for r in dedup.first_sight(df, tiebreak=("event_id",)).collect())
    assert got == brute_ttl(rows, DAY)
    assert len(got) > 25  # some ids passed more than once


def test_hot_id_single_period(spark):
    rows = [("hot", 1000 + i, i) for i in range(5000)] + [("cold", 5, 99999)]
    df = spark.createDataFrame(rows, "click_id string, timestamp_ms long, event_id long")
    got = sorted(tuple(r) for r in dedup.first_sight(df, tiebreak=("event_id",)).collect())
    assert got == [("cold", 5, 99999), ("hot", 1000, 0)]


def test_chunked_audit_equals_brute_force(spark):
    arr = derived.with_arrival(derived.load_clicks(spark, SF01))
    n = derived.N_SOURCE_PARTS
    got = {(r.event_id, r.seq, r.part, r.max_before_ms): r.is_late
           for r in lateness.lateness_audit(arr, n, window_ms=3_600_000, chunk=97).collect()}
    rows = sorted(arr.select("seq", "event_id", "part", "timestamp_ms").collect())
    seen, expect, high, fell = {}, {}, None, 0
    for r in rows:
        if seen:
            low = min(seen.values())
            fell += high is not None and low < high
            high = low if high is None else max(high, low)
        end = r.timestamp_ms // 3_600_000 * 3_600_000 + 3_600_000
        expect[(r.event_id, r.seq, r.part, high)] = high is not None and end + 30_000 <= high - 10_000
        seen[r.part] = max(seen.get(r.part, 0), r.timestamp_ms)
    assert got == expect and 0 < sum(got.values()) < len(got)


def test_audit_with_idle_partitions_equals_brute_force(spark):
    """The arrivals of the registered query: partition 3 falls silent and returns, which would
    lower a watermark without memory."""
    arr = derived.with_arrival(derived.load_clicks(spark, SF01))
    got = {(r.event_id, r.max_before_ms): r.is_late
           for r in lateness.lateness_audit(arr, derived.N_SOURCE_PARTS, window_ms=3_600_000, chunk=97, arrived="arrived_ms").collect()}
    seen, active, expect, high, fell = {}, {}, {}, None, 0
    for r in sorted(arr.select("seq", "event_id", "part", "timestamp_ms", "arrived_ms").collect()):
        if seen:
            newest = max(active.values())
            low = min(seen[p] for p in seen if active[p] >= newest - 300_000)
            fell += high is not None and low < high
            high = low if high is None else max(high, low)
        end = r.timestamp_ms // 3_600_000 * 3_600_000 + 3_600_000
        expect[(r.event_id, high)] = high is not None and end + 30_000 <= high - 10_000
        seen[r.part] = max(seen.get(r.part, 0), r.timestamp_ms)
        active[r.part] = r.arrived_ms
    assert got == expect and fell > 0


def test_building_the_dedup_needs_only_narrow_columns(spark):
    """No id passes twice: the plan is one aggregation of the payload; ids that pass
    again join it once."""
    rows = [(f"id-{i}", 1000 + i, i) for i in range(50)]
    df = spark.createDataFrame(rows, "click_id string, timestamp_ms long, event_id long")
    assert "Join" not in dedup.first_sight(df, tiebreak=("event_id",))._jdf.queryExecution().executedPlan().toString()
    more = df.union(spark.createDataFrame([("id-3", 1003 + DAY, 99)], df.schema))
    assert dedup.first_sight(more, tiebreak=("event_id",)).count() == 51


def test_late_rule_t1(spark):
    df = spark.createDataFrame([(59_999, 90_000), (59_999, 89_999), (0, None)], "ts long, wm long")
    got = [r[0] for r in df.select(lateness.is_late(F.col("ts"), F.col("wm"), 60_000, 30_000)).collect()]
    assert got == [True, False, False]
