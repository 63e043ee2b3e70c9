"""Intake service cases: enrichment chain, dedup counters, privacy projection,
and the streaming ingest query (Q1)."""

import json
import os


from clickwise.operators import dedup, enrich
from clickwise.operators.georanges import range_country
from clickwise.schemas import CLICK_REQUEST
from clickwise.sources.streams import request_log_stream
from clickwise.config import JobConfig
from clickwise.streaming.ingest import intake_counts, openings, start_ingest

T0 = 1_704_067_200_000


def req(ad, click=None, session=None, placement=None, xff=None, ua="Mozilla/5.0", t=T0, advertiser=None):
    return (ad, click, placement, session, advertiser, ua, xff, None, None, t)


def events(spark, rows):
    return enrich.ingest(spark.createDataFrame(rows, CLICK_REQUEST))


def test_new_click_published_duplicate_dropped(spark):
    rows = [req("ad-123", "click-1"), req("ad-123", "click-dup"), req("ad-123", "click-dup", t=T0 + 10),
            req("ad-456", "click-2"), req("ad-456", "click-dup2")]
    ev = events(spark, rows)
    passed = dedup.first_sight(ev)
    counts = dedup.dedup_counts(ev, passed).first()
    assert (counts.published, counts.duplicates) == (4, 1)
    assert sorted(r.click_id for r in passed.collect()) == ["click-1", "click-2", "click-dup", "click-dup2"]


def test_given_id_kept_missing_generated_repeat_duplicate(spark):
    rows = [req("ad-123", "explicit-click-uuid", "sess-abc", xff="203.0.113.42"),
            req("ad-456", None, "sess-xyz", "placement-1"),
            req("ad-dup-test", None, "sess-dup", t=T0 + 100), req("ad-dup-test", None, "sess-dup", t=T0 + 200)]
    ev = events(spark, rows).collect()
    assert ev[0].click_id == "explicit-click-uuid"
    assert len(ev[1].click_id) == 36 and ev[1].click_id.count("-") == 4
    assert ev[2].click_id == ev[3].click_id  # same ad/session/5 s bucket -> same id (T8)
    assert dedup.first_sight(events(spark, rows)).count() == 3


def test_event_defaults_and_privacy(spark):
    ev = events(spark, [req("ad-1", "c1", ua=None)])
    assert "raw_ip" not in ev.columns and "x_forwarded_for" not in ev.columns
    r = ev.first()
    assert (r.advertiser_id, r.user_agent, r.hashed_ip, r.device_type, r.country) == \
        ("unknown", "", "unknown", "UNKNOWN", None)
    r = events(spark, [req("ad-1", "c1", xff="203.0.113.42", ua="Mozilla/5.0 (iPhone)")]).first()
    assert r.country == "US" and r.device_type == "MOBILE" and len(r.hashed_ip) == 64


def test_geo_range_join_and_ad_dimension(spark):
    nation = spark.createDataFrame([(0, "N0"), (20, "N20")], "n_nationkey int, n_name string")
    geo = enrich.geo_ranges_from_nation(nation)
    df = spark.createDataFrame([("203.0.113.1",), ("9.255.255.255",), ("10.0.0.1",), (None,), ("::1",)], "raw_ip string")
    got = [r.country for r in df.transform(range_country(geo)).orderBy("raw_ip").collect()]
    assert sorted(got, key=str) == sorted(["N20", "N0", None, None, None], key=str)
    ads = spark.createDataFrame([("ad-1", "adv-9", "https://x/1")], "ad_id string, advertiser_id string, destination_url string")
    rq = spark.createDataFrame([("ad-1", None), ("ad-2", None), ("ad-1", "adv-own")], "ad_id string, advertiser_id string")
    out = sorted(tuple(r) for r in rq.transform(enrich.ad_dimension(ads)).collect())
    assert out == [("ad-1", "adv-9", "https://x/1"), ("ad-1", "adv-own", "https://x/1"),
                   ("ad-2", "unknown", "https://example.com?ad_id=ad-2&source=clickagg")]


def test_anti_join_seen(spark):
    batch = spark.createDataFrame([("a",), ("b",), ("c",)], "click_id string")
    seen = spark.createDataFrame([("a", 1000), ("b", 10)], "click_id string, seen_ms long")
    out = sorted(r.click_id for r in dedup.anti_join_seen(batch, seen, now_ms=2000, ttl_ms=1500).collect())
    assert out == ["b", "c"]  # b's sight expired


def test_streaming_ingest_dedups_across_batches(spark, tmp):
    src = os.path.join(tmp, "req")
    os.makedirs(src)
    names = ["ad_id", "click_id", "placement_id", "session_id", "advertiser_id", "user_agent",
             "x_forwarded_for", "x_real_ip", "remote_addr", "ts_ms"]
    batches = [[req("ad-1", "c1"), req("ad-1", "c2")], [req("ad-1", "c1", t=T0 + 60_000)], [req("ad-1", "c3")]]
    for i, rows in enumerate(batches):
        with open(os.path.join(src, f"{i}.json"), "w") as f:
            for r in rows:
                f.write(json.dumps(dict(zip(names, r))) + "\n")
        os.utime(os.path.join(src, f"{i}.json"), (1e9 + i, 1e9 + i))
    out = os.path.join(tmp, "events")
    q = start_ingest(request_log_stream(spark, src, max_files_per_trigger=1), out, os.path.join(tmp, "ck"),
                     trigger={"availableNow": True})
    q.awaitTermination(120)
    got = sorted(r.click_id for r in spark.read.parquet(out).collect())
    assert got == ["c1", "c2", "c3"]
    pubs = [p["observedMetrics"]["published"]["published"] for p in q.recentProgress
            if p.get("observedMetrics", {}).get("published")]
    assert sum(pubs) == 3


HOUR = 3_600_000


def run_ingest(spark, tmp, batches, cfg=JobConfig()):
    """One file of requests per micro-batch; (click id, ms since T0) of what passes, and the counts."""
    src, out = os.path.join(tmp, "req"), os.path.join(tmp, "events")
    os.makedirs(src)
    names = ["ad_id", "click_id", "placement_id", "session_id", "advertiser_id", "user_agent",
             "x_forwarded_for", "x_real_ip", "remote_addr", "ts_ms"]
    for i, rows in enumerate(batches):
        with open(os.path.join(src, f"{i:03d}.json"), "w") as f:
            for click, t in rows:
                f.write(json.dumps(dict(zip(names, req("ad-1", click, t=T0 + t)))) + "\n")
        os.utime(os.path.join(src, f"{i:03d}.json"), (1e9 + i, 1e9 + i))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    q = start_ingest(request_log_stream(spark, src, max_files_per_trigger=1), out, os.path.join(tmp, "ck"), cfg,
                     trigger={"availableNow": True})
    q.awaitTermination(240)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    return sorted((r.click_id, r.timestamp_ms - T0) for r in spark.read.parquet(out).collect()), intake_counts(q.recentProgress)


def test_openings_of_periods():
    import numpy as np
    day = 24 * HOUR
    times = np.array([0, 5, day - 1, day, day + 5, 3 * day, 4 * day - 1, 4 * day])
    assert openings(times, None, day)[0].tolist() == [True, False, False, True, False, True, False, True]
    passed, start = openings(times, -1, day)
    assert passed.tolist() == [False, False, True, False, False, True, False, True] and start == 4 * day
    assert openings(times[:2], -10, day)[0].tolist() == [False, False] and openings(times[:2], -10, day)[1] == -10


def test_stream_passes_what_the_batch_rule_passes(spark, tmp):
    """Recurrences after 1, 20, 25, 30, 47 and 51 hours, over seven micro-batches."""
    batches = [[("x", 0), ("y", 0)], [("x", 1), ("w", 2), ("x", 20)], [("w", 22), ("x", 25)], [("w", 27), ("x", 30)], [("y", 47), ("z", 47.5)],
               [("x", 51), ("x", 51)], [("z", 60)]]
    batches = [[(c, int(h * HOUR)) for c, h in b] for b in batches]
    rows = [r for b in batches for r in b]
    got, counts = run_ingest(spark, tmp, batches)
    df = spark.createDataFrame([(c, t, i) for i, (c, t) in enumerate(rows)], "click_id string, timestamp_ms long, event_id long")
    want = sorted((r.click_id, r.timestamp_ms) for r in dedup.first_sight(df, tiebreak=("event_id",)).collect())
    assert got == want and ("x", 25 * HOUR) in got and ("y", 47 * HOUR) in got and ("x", 51 * HOUR) in got
    assert counts == {"requests": len(rows), "published": len(want), "too_old": 0, "duplicates": len(rows) - len(want)}


def test_sights_of_one_batch_and_too_old_ones(spark, tmp):
    """A batch may hold several periods of an id; what is older than the watermark is counted, not passed."""
    cfg = JobConfig(dedup_lateness_hours=2)
    batches = [[("a", 30 * HOUR), ("a", 0), ("a", 23 * HOUR), ("a", 31 * HOUR)], [("b", 40 * HOUR)], [("b", 41 * HOUR)],
               [("c", 37 * HOUR), ("b", 39 * HOUR), ("a", 53 * HOUR)], [("a", 55 * HOUR)]]
    got, counts = run_ingest(spark, tmp, batches, cfg)
    assert got == [("a", 0), ("a", 30 * HOUR), ("a", 55 * HOUR), ("b", 40 * HOUR)]
    assert counts == {"requests": 10, "published": 4, "too_old": 1, "duplicates": 5}


def test_anti_join_seen_batches_cross_day(spark):
    day = dedup.DAY_MS
    batch = spark.createDataFrame([("a", 2 * day), ("b", 2 * day), ("c", 2 * day), ("d", 2 * day)],
                                  "click_id string, batch_start_ms long")
    seen = spark.createDataFrame([("a", 2 * day - 3_600_000),   # seen 1 h before: dropped
                                  ("b", day - 1),               # more than 24 h before: kept
                                  ("c", 2 * day + 5)],          # seen after the batch start: kept
                                 "click_id string, seen_ms long")
    out = sorted(r.click_id for r in dedup.anti_join_seen_batches(batch, seen).collect())
    assert out == ["b", "c", "d"]
