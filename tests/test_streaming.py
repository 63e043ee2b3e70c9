"""Streaming: file source, one file per micro-batch, hand-computed answers
for on-time / late-accepted / late-rejected rows (FIXTURES section 4)."""

import json
import os
import re
import time

from pyspark.sql import functions as F, types as T

from clickwise.config import JobConfig
from clickwise.schemas import CLICK_EVENT
from clickwise.sources import fs
from clickwise.sources.streams import file_stream
from clickwise.streaming.job import AggregationPaths, run_aggregation
from clickwise.streaming.minutes import MinuteTables, committed_batch, read_final_minutes, read_minutes, read_rollup
from clickwise.streaming.splitter import LateSplitter, current_watermark_ms, start_splitter

BASE_MS = 1_704_067_200_000  # 2024-01-01 00:00:00 UTC


def ms(mm_ss: str) -> int:
    m, s = mm_ss.split(":")
    return BASE_MS + int(round((int(m) * 60 + float(s)) * 1000))


# (file, [(click, "mm:ss")])
BATCHES = [
    [("c1", "00:05"), ("c1", "00:06"), ("c2", "00:59.999")],
    [("c3", "01:30")],
    [("c4", "00:30")],
    [("c5", "01:45")],
    [("c6", "00:31"), ("c7", "01:46")],
    [("c8", "03:30")],
    [("c9", "03:31")],
]


def event(click, ts):
    return {"click_id": click, "ad_id": "ad-1", "advertiser_id": "adv-1", "placement_id": None,
            "session_id": "s" + click[1:], "hashed_ip": "abc123hashed", "user_agent": "Mozilla/5.0",
            "country": "US", "device_type": "DESKTOP", "timestamp_ms": ms(ts)}


def write_batches(folder):
    os.makedirs(folder, exist_ok=True)
    now = time.time() - 100
    for i, rows in enumerate(BATCHES):
        p = os.path.join(folder, f"batch-{i}.json")
        with open(p, "w") as f:
            for click, ts in rows:
                f.write(json.dumps(event(click, ts)) + "\n")
        os.utime(p, (now + i, now + i))


PARTED = T.StructType(CLICK_EVENT.fields + [T.StructField("part", T.LongType())])


def parted(spark, rows):
    """A micro-batch of (click, "mm:ss", source partition[, ad])."""
    return spark.createDataFrame([tuple((event(c, t) | ({"ad_id": ad[0]} if ad else {})).values()) + (p,)
                                  for c, t, p, *ad in rows], PARTED)


def minute_counts(spark, tables):
    return {int((r.window_start.timestamp() * 1000 - BASE_MS) // 60000): r.click_count for r in read_minutes(spark, tables).collect()}


def run_split(spark, tmp, cfg=JobConfig()):
    src = os.path.join(tmp, "events")
    write_batches(src)
    events = file_stream(spark, src, CLICK_EVENT, "json", max_files_per_trigger=1)
    q = start_splitter(events, os.path.join(tmp, "split"), os.path.join(tmp, "ck-split"), cfg,
                       trigger={"availableNow": True})
    q.awaitTermination(180)
    return os.path.join(tmp, "split")


def test_splitter_late_set_and_ledger(spark, tmp):
    split = run_split(spark, tmp)
    late = spark.read.parquet(f"{split}/late")
    assert sorted(r.click_id for r in late.collect()) == ["c6"]
    texts = [r.value for r in spark.read.text(f"{split}/late_text").collect()]
    assert texts == ["LATE:c6 adId=ad-1"]
    accepted = spark.read.parquet(f"{split}/accepted")
    assert accepted.count() == 9  # 10 rows, c6 late
    # watermark recorded with the late row: max before batch 4 (01:45) - 10 s
    wm = late.select("watermark_ms").first()[0]
    assert wm == ms("01:35")
    led = spark.read.parquet(f"{split}/ledger/batch_id=6").collect()
    assert len(led) == 1 and led[0]["max_event_ms"] == ms("03:31")


def test_splitter_rerun_is_idempotent(spark, tmp):
    split = run_split(spark, tmp)
    before = sorted(tuple(r) for r in spark.read.parquet(f"{split}/accepted").collect())
    # re-invoke the last batch by hand with the same rows: same outputs
    splitter = LateSplitter(split, JobConfig())
    rows = spark.createDataFrame([event(c, t) for c, t in BATCHES[6]], CLICK_EVENT)
    splitter(rows, 6)
    after = sorted(tuple(r) for r in spark.read.parquet(f"{split}/accepted").collect())
    assert before == after
    assert [r.click_id for r in spark.read.parquet(f"{split}/late").collect()] == ["c6"]


def run_job(spark, tmp, **kw):
    src = os.path.join(tmp, "events")
    write_batches(src)
    paths = AggregationPaths(src, os.path.join(tmp, "split"), os.path.join(tmp, "tables"), os.path.join(tmp, "ck"))
    q = run_aggregation(spark, JobConfig(), paths, trigger={"availableNow": True}, max_files_per_trigger=1, **kw)
    q.awaitTermination(300)
    return paths


def test_job_counts_rollups_and_report(spark, tmp):
    from clickwise.plans.report import click_report
    paths = run_job(spark, tmp)
    tables = paths.tables_base
    assert minute_counts(spark, tables) == {0: 3, 1: 3, 3: 2}
    assert {r.unique_sessions for r in read_minutes(spark, tables).collect()} == {3, 2}
    final = sorted(r.click_count for r in read_final_minutes(spark, tables, paths.split_base).collect())
    assert final == [3, 3]  # watermark 03:21: minute 3 (ends 04:00) is still open
    hourly = read_rollup(spark, tables, "hourly").collect()
    assert [(r.click_count, r.unique_sessions_est) for r in hourly] == [(8, 8)]
    assert [r.click_count for r in read_rollup(spark, tables, "daily").collect()] == [8]
    # RPT-1 reads the job's tables
    minute = {r.window_start.minute: r.click_count for r in click_report(spark, tables, "minute").collect()}
    assert minute == {0: 3, 1: 3, 3: 2}
    hour = click_report(spark, tables, "hour", advertiser_id="adv-1", start="2024-01-01 00:00:00", end="2024-01-01 01:00:00")
    assert [r.click_count for r in hour.collect()] == [8]
    assert click_report(spark, tables, "day", start="2024-01-02").count() == 0
    # month partitions and time filters reach the scan of the streamed table
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = click_report(spark, tables, "hour", advertiser_id="adv-1", start="2024-01-01")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PartitionFilters: \[[^]]*month#\d+ >= 202401", plan) and "EqualTo(advertiser_id,adv-1)" in plan
    # the job keeps neither accepted clicks nor old ledgers
    assert not fs.exists(spark, f"{paths.split_base}/accepted")
    assert fs.child_dirs(spark, f"{paths.split_base}/ledger") == ["batch_id=5", "batch_id=6"]


def test_lagging_partition_loses_no_accepted_click(spark, tmp):
    """Partition 0 lags partition 1 by ten minutes: its clicks are accepted, so they count."""
    tables = MinuteTables(os.path.join(tmp, "tables"))
    splitter = LateSplitter(os.path.join(tmp, "split"), JobConfig(), part_col="part", clock=lambda: 0, tables=tables)
    batches = [[("a1", "00:05", 0), ("b1", "10:00", 1)], [("a2", "00:20", 0), ("b2", "10:30", 1)],
               [("a3", "00:40", 0), ("b3", "11:00", 1)], [("a4", "00:50", 0), ("b4", "11:30", 1)]]
    for i, rows in enumerate(batches):
        splitter(parted(spark, rows), i)
    late = spark.read.parquet(f"{tmp}/split/late").count() if fs.exists(spark, f"{tmp}/split/late") else 0
    accepted = spark.read.parquet(f"{tmp}/split/accepted").count()
    counted = sum(minute_counts(spark, tables.base).values())
    assert (accepted, late, counted) == (8, 0, 8)
    assert minute_counts(spark, tables.base) == {0: 4, 10: 2, 11: 2}


def test_replayed_batch_changes_nothing(spark, tmp):
    tables = MinuteTables(os.path.join(tmp, "tables"))
    b0 = parted(spark, [("a1", "00:05", 0), ("a2", "59:59", 0)]).drop("part")
    b1 = parted(spark, [("a3", "00:10", 0), ("x1", "61:00", 0, "ad-2")]).drop("part")

    def snapshot():
        return (sorted((str(r.window_start), r.ad_id, r.click_count) for r in read_minutes(spark, tables.base).collect()),
                sorted((str(r.window_hour), r.ad_id, r.click_count) for r in read_rollup(spark, tables.base, "hourly").collect()),
                sorted((str(r.window_day), r.ad_id, r.click_count) for r in read_rollup(spark, tables.base, "daily").collect()))

    tables(b0, 0)
    tables(b1, 1)
    first = snapshot()
    assert [c for _, _, c in first[0]] == [2, 1, 1] and [c for _, _, c in first[2]] == [3, 1]
    tables(b1, 1)  # replay
    assert snapshot() == first
    # a batch that failed before its commit is not seen
    tables._partials(b1.withColumn("click_id", F.lit("zz")), 2)
    tables._write(spark.createDataFrame([(BASE_MS, "ad-9", "adv-9", "US", "DESKTOP", 99, 99, None, False)],
                                        "window_hour_ms long, ad_id string, advertiser_id string, country string, "
                                        "device_type string, click_count long, unique_sessions long, session_sketch binary, is_base boolean"),
                  "clicks_hourly", "window_hour", 2)
    assert committed_batch(spark, tables.base) == 1 and snapshot() == first


def rows_of(spark, base):
    """Everything a reader sees: minutes, hours and days."""
    return (sorted((str(r.window_start), r.ad_id, r.advertiser_id, r.click_count, r.unique_sessions) for r in read_minutes(spark, base).collect()),
            sorted((str(r.window_hour), r.ad_id, r.advertiser_id, r.click_count, r.unique_sessions, r.unique_sessions_est)
                   for r in read_rollup(spark, base, "hourly").collect()),
            sorted((str(r.window_day), r.ad_id, r.advertiser_id, r.click_count, r.unique_sessions) for r in read_rollup(spark, base, "daily").collect()))


def clicks_of(spark, rows):
    """(click, "mm:ss", ad, advertiser, session) as click events."""
    return spark.createDataFrame([tuple((event(c, t) | {"ad_id": ad, "advertiser_id": adv, "session_id": ses}).values()) for c, t, ad, adv, ses in rows], CLICK_EVENT)


STREAMED = [[("a1", "00:30", "ad-1", "adv-1", "s1"), ("a2", "01:10", "ad-1", "adv-1", "s1"), ("x1", "00:10", "ad-2", "adv-2", "s2")],
            [("a3", "00:40", "ad-1", "adv-1", "s3"), ("a1", "00:30", "ad-1", "adv-1", "s1"), ("a4", "61:00", "ad-1", "adv-1", "s1")],
            # an earlier click of the first minute: the row goes over to another advertiser
            [("a5", "00:05", "ad-1", "adv-9", "s4"), ("x2", "00:20", "ad-2", "adv-2", "s5")],
            [("a6", "02:00", "ad-1", "adv-9", "s4"), ("a7", "1500:00", "ad-1", "adv-1", "s6"), ("a2", "01:15", "ad-1", "adv-1", "s7")]]


def batch_rollup(spark, upto):
    """Minutes, hours and days of all clicks at once, by the batch functions."""
    from clickwise.operators import rollup
    from clickwise.operators.aggregate import window_aggregate
    m = window_aggregate(clicks_of(spark, [r for b in STREAMED[:upto] for r in b]), "1 minute", exact_sessions=True, with_sketch=True)
    hours = rollup.hourly_with_estimate(m)
    out = []
    for df, col in ((m, "window_start_ms"), (hours, "window_hour_ms"), (rollup.daily(hours), "window_day_ms")):
        est = ["unique_sessions_est"] if "unique_sessions_est" in df.columns else []
        out.append(sorted((str(r.period), *tuple(r)[1:]) for r in df.select(
            F.timestamp_millis(col).alias("period"), "ad_id", "advertiser_id", "click_count", "unique_sessions", *est).collect()))
    return tuple(out)


def test_compaction_beside_a_running_stream(spark, tmp):
    """STR-12, AGG-10, AGG-11: batch, compact, batch, replay, compact: always what the batch rollup gives."""
    from clickwise.plans.report import click_report
    from clickwise.streaming.minutes import COMPACTED, compact_tables
    tables = MinuteTables(os.path.join(tmp, "tables"))
    for b, rows in enumerate(STREAMED):
        tables(clicks_of(spark, rows), b)
        assert rows_of(spark, tables.base) == batch_rollup(spark, b + 1), b
        if b in (1, 2):
            assert compact_tables(spark, tables.base) == dict.fromkeys(COMPACTED, b)
            assert compact_tables(spark, tables.base) == dict.fromkeys(COMPACTED)
            assert rows_of(spark, tables.base) == batch_rollup(spark, b + 1), b
        if b == 3:
            tables(clicks_of(spark, rows), b)  # replay
            assert rows_of(spark, tables.base) == batch_rollup(spark, 4)
    # what the first compaction replaced is gone, what the second did is kept for readers under way
    assert fs.child_dirs(spark, f"{tables.base}/clicks_1min/month=202401") == ["batch_id=2", "batch_id=3"]
    assert fs.child_dirs(spark, f"{tables.base}/_partials/ids") == ["batch_id=2", "batch_id=3"]
    assert fs.child_dirs(spark, f"{tables.base}/clicks_hourly/_compactions") == ["1", "2"]
    # a compaction that failed before its marker is not seen, and the next attempt replaces it
    spark.range(3).write.parquet(f"{tables.base}/clicks_daily/_compacted/3")
    assert rows_of(spark, tables.base) == batch_rollup(spark, 4)
    compact_tables(spark, tables.base)
    assert rows_of(spark, tables.base) == batch_rollup(spark, 4)
    # reports: sums as stored, and distinct sessions over any range
    day = {r.advertiser_id: (r.click_count, r.unique_sessions) for r in click_report(spark, tables.base, "day", per_period=False).collect()}
    merged = {r.advertiser_id: (r.click_count, r.unique_sessions)
              for r in click_report(spark, tables.base, "day", per_period=False, sessions="merged").collect()}
    assert day == {"adv-1": (3, 4), "adv-2": (2, 2), "adv-9": (4, 4)}
    assert merged == {"adv-1": (3, 3), "adv-2": (2, 2), "adv-9": (4, 3)}
    by_minute = click_report(spark, tables.base, "minute", per_period=False, sessions="merged", advertiser_id="adv-9").collect()
    assert [(r.click_count, r.unique_sessions) for r in by_minute] == [(4, 3)]


def test_a_batch_reads_no_stored_table(spark, tmp):
    """STR-12: the cost of a batch follows its own windows: it works with the stored rows out of reach."""
    tables = MinuteTables(os.path.join(tmp, "tables"))
    for b, rows in enumerate(STREAMED[:3]):
        tables(clicks_of(spark, rows), b)
    before = {n: spark.read.parquet(f"{tables.base}/{n}").drop("month") for n in ("clicks_1min", "clicks_hourly", "clicks_daily")}
    before = {n: df.toPandas() for n, df in before.items()}
    for n in before:
        for b in range(3):
            fs.delete(spark, f"{tables.base}/{n}/month=202401/batch_id={b}")
    tables(clicks_of(spark, STREAMED[3]), 3)
    hours = spark.read.parquet(f"{tables.base}/clicks_hourly").filter("batch_id = 3").select("advertiser_id", "click_count").collect()
    assert sorted(map(tuple, hours)) == [("adv-1", 0), ("adv-1", 1), ("adv-9", 1)]
    # only batches that share an hour with this one are opened
    assert sorted(tables._spans(spark)) == [(b, BASE_MS // 3_600_000, BASE_MS // 3_600_000 + h) for b, h in enumerate((0, 1, 0, 25))]


def test_a_click_of_a_closed_hour_is_refused(spark, tmp):
    import pytest
    tables = MinuteTables(os.path.join(tmp, "tables"))
    tables(parted(spark, [("a1", "00:05", 0), ("a2", "00:06", 0)]).drop("part"), 0, ms("90:00"))
    with pytest.raises(ValueError, match="partial states are gone"):
        tables(parted(spark, [("a3", "00:07", 0)]).drop("part"), 1, ms("90:00"))
    assert minute_counts(spark, tables.base) == {0: 2}


def test_live_batch_is_written_by_many_tasks(spark, tmp):
    """One hour, one hot ad: the minute rows still come from more than one task."""
    tables = MinuteTables(os.path.join(tmp, "tables"))
    rows = (spark.range(20_000).select(
        F.concat(F.lit("c"), F.col("id")).alias("click_id"), F.lit("ad-1").alias("ad_id"), F.lit("adv-1").alias("advertiser_id"),
        F.lit(None).cast("string").alias("placement_id"), F.concat(F.lit("s"), F.col("id") % 500).alias("session_id"), F.lit("h").alias("hashed_ip"),
        F.lit("ua").alias("user_agent"), F.concat(F.lit("C"), F.col("id") % 50).alias("country"), F.lit("MOBILE").alias("device_type"),
        (F.lit(BASE_MS) + (F.col("id") % 60) * 60_000).alias("timestamp_ms")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if the rows were large
    try:
        tables(rows, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(minute_counts_all(spark, tables.base)) == 20_000
    files = spark.read.parquet(f"{tables.base}/clicks_1min").select(F.input_file_name()).distinct().count()
    assert files > 1


def minute_counts_all(spark, base):
    return [r.click_count for r in read_minutes(spark, base).collect()]


def test_partials_of_closed_hours_go(spark, tmp):
    tables = MinuteTables(os.path.join(tmp, "tables"))
    tables(parted(spark, [("a1", "00:05", 0)]).drop("part"), 0, None)
    tables(parted(spark, [("a2", "125:00", 0)]).drop("part"), 1, ms("120:00"))
    assert fs.child_dirs(spark, f"{tables.base}/_partials/ids") == ["batch_id=1"]
    assert fs.child_dirs(spark, f"{tables.base}/_partials/sketches") == ["batch_id=1"]
    assert minute_counts(spark, tables.base) == {0: 1, 125: 1}


def test_job_writes_jdbc_rows_of_seven_columns(spark, tmp):
    url = f"jdbc:derby:memory:clickwisejob{os.getpid()};create=true"
    props = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    cfg_jdbc = JobConfig(jdbc_url=url, jdbc_driver=props["driver"]).jdbc
    run_job(spark, tmp, jdbc=cfg_jdbc)
    back = spark.read.jdbc(url, "clicks_1min", properties=props)
    assert [c.lower() for c in back.columns] == ["window_start", "ad_id", "advertiser_id", "country", "device_type",
                                                 "click_count", "unique_sessions"]
    best = back.groupBy("window_start").agg(F.max("click_count").alias("c"))
    assert sorted(r.c for r in best.collect()) == [2, 3, 3]


def test_late_topic_without_the_package_fails(spark, tmp):
    import pytest
    events = file_stream(spark, tmp, CLICK_EVENT, "json")
    with pytest.raises(RuntimeError):
        start_splitter(events, f"{tmp}/s", f"{tmp}/c", late_topic_servers="localhost:9092")


def test_idle_partition_leaves_the_watermark(spark, tmp):
    """STR-2: a source partition silent for longer than the idle timeout no
    longer holds the watermark back."""
    clock = {"now": 0}
    splitter = LateSplitter(os.path.join(tmp, "split"), JobConfig(), part_col="part", clock=lambda: clock["now"])

    def batch(rows):
        return parted(spark, rows)

    splitter(batch([("a1", "00:05", 0), ("b1", "10:00", 1)]), 0)
    # both partitions active: watermark = min(00:05, 10:00) - 10 s -> nothing late
    assert splitter.watermark_ms(spark, 1) == ms("00:05") - 10_000
    clock["now"] = 2 * 60_000
    splitter(batch([("b2", "10:30", 1)]), 1)
    assert splitter.watermark_ms(spark, 2) == ms("00:05") - 10_000   # partition 0 idle 2 min: still counts
    clock["now"] = 6 * 60_000
    splitter(batch([("b3", "11:00", 1)]), 2)
    # partition 0 silent for 6 min (> 5): the watermark follows partition 1
    assert splitter.watermark_ms(spark, 3) == ms("11:00") - 10_000
    splitter(batch([("a2", "00:06", 0)]), 3)
    late = [r.click_id for r in spark.read.parquet(f"{tmp}/split/late").collect()]
    assert late == ["a2"]
    assert current_watermark_ms(spark, f"{tmp}/split") == splitter.watermark_ms(spark, 4)


def test_a_returning_partition_does_not_lower_the_watermark(spark, tmp):
    """STR-1/2: partition 1 idles while partition 0 closes an hour and its partials go; its next
    clicks of that hour are late, and the stored minute keeps its four clicks."""
    clock = {"now": 0}
    tables = MinuteTables(os.path.join(tmp, "tables"))
    splitter = LateSplitter(os.path.join(tmp, "split"), JobConfig(), part_col="part", clock=lambda: clock["now"], tables=tables)
    marks = []

    def run(minute, rows):
        clock["now"] = minute * 60_000
        splitter(parted(spark, rows), len(marks))
        marks.append(current_watermark_ms(spark, splitter.base))

    run(0, [("a1", "00:05", 0), ("a2", "00:10", 0), ("b1", "00:20", 1), ("b2", "00:30", 1)])
    assert minute_counts(spark, tables.base) == {0: 4}
    run(60, [("a3", "150:00", 0)])
    run(61, [("b3", "00:40", 1)])          # back after an hour: late
    run(62, [("b4", "00:50", 1), ("a4", "151:00", 0)])
    run(63, [("b5", "152:00", 1)])
    assert marks == sorted(marks) and marks[1] == ms("149:50")
    assert minute_counts(spark, tables.base) == {0: 4, 150: 1, 151: 1, 152: 1}
    assert sorted(r.click_id for r in spark.read.parquet(f"{tmp}/split/late").collect()) == ["b3", "b4"]


def test_a_ledger_without_a_watermark_is_read(spark, tmp):
    """Ledgers of an earlier release give their partitions' minimum."""
    splitter = LateSplitter(os.path.join(tmp, "split"), JobConfig(), part_col="part")
    spark.createDataFrame([(0, ms("10:00"), 5), (1, ms("12:00"), 5)], "part long, max_event_ms long, last_active_ms long") \
         .write.parquet(splitter.path("ledger", 3))
    assert splitter.watermark_ms(spark, 4) == ms("10:00") - 10_000


def test_decode_values_json_keeps_partition(spark):
    from clickwise.sources.streams import decode_values
    raw = spark.createDataFrame([(json.dumps(event("c1", "00:05")).encode(), 3)], "value binary, partition int")
    out = decode_values(raw, CLICK_EVENT).collect()[0]
    assert out.click_id == "c1" and out.timestamp_ms == ms("00:05") and out.source_partition == 3


def test_avro_schema_and_frame(spark):
    from clickwise.sources.streams import add_frame, avro_schema, strip_frame
    fields = {f["name"]: f["type"] for f in json.loads(avro_schema())["fields"]}
    assert list(fields) == ["click_id", "ad_id", "advertiser_id", "placement_id", "session_id", "hashed_ip", "user_agent",
                            "country", "device_type", "timestamp_ms"]
    assert [n for n, t in fields.items() if t == ["null", "string"]] == ["placement_id", "session_id", "country"]
    assert fields["device_type"] == {"type": "enum", "name": "DeviceType", "symbols": ["DESKTOP", "MOBILE", "TABLET", "UNKNOWN"]}
    assert fields["timestamp_ms"] == "long" and fields["click_id"] == "string"
    body = spark.createDataFrame([(b"\x02abc",)], "value binary")
    framed = body.select(add_frame(F.col("value"), 258).alias("value"))
    assert bytes(framed.first().value) == b"\x00\x00\x00\x01\x02" + b"\x02abc"
    assert bytes(framed.select(strip_frame(F.col("value")).alias("v")).first().v) == b"\x02abc"


def test_retention_on_streaming_tables(spark, tmp):
    """SNK-7 on the job's month partitions: whole months go by name, the horizon's month is rewritten."""
    from clickwise.sinks.tables import apply_retention
    tables = MinuteTables(os.path.join(tmp, "tables"))
    day = 86_400_000
    rows = [tuple((event(f"c{k}", "00:05") | {"timestamp_ms": BASE_MS + k * day}).values()) for k in (-1, 0, 1, 2)]
    tables(spark.createDataFrame(rows, CLICK_EVENT), 0)
    touched = apply_retention(spark, f"{tables.base}/clicks_1min", "window_start", "2026-01-02 12:00:00")
    assert touched == [202312, 202401]
    left = sorted(str(r.window_start)[:10] for r in read_minutes(spark, tables.base).collect())
    assert left == ["2024-01-03"]
    # the stream goes on in the same layout, and a compacted table loses its expired rows too
    from clickwise.streaming.minutes import compact_tables
    tables(spark.createDataFrame([tuple((event("c9", "00:05") | {"timestamp_ms": BASE_MS + 40 * day}).values())], CLICK_EVENT), 1)
    compact_tables(spark, tables.base)
    assert apply_retention(spark, f"{tables.base}/clicks_1min", "window_start", "2026-01-10 00:00:00") == [202401]
    assert [str(r.window_start)[:10] for r in read_minutes(spark, tables.base).collect()] == ["2024-02-10"]
