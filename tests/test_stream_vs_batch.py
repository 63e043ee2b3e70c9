"""Stream result == batch result on the same input (sf0.001 clicks replayed
as micro-batch files in arrival order, 4 source partitions)."""

import json
import os

from pyspark.sql import functions as F, types as T

from clickwise.config import JobConfig
from clickwise.operators.aggregate import window_aggregate
from clickwise.schemas import CLICK_EVENT
from clickwise.sources import derived
from clickwise.sources.streams import file_stream
from clickwise.streaming.splitter import start_splitter
from clickwise.streaming.minutes import MinuteTables, read_minutes
from tests.conftest import SF001

PER_BATCH = 100
SCHEMA = T.StructType(CLICK_EVENT.fields + [T.StructField("part", T.LongType()),
                                             T.StructField("seq", T.LongType())])


def expected_late(rows, cfg):
    """Brute force: watermark of batch b = the highest so far of the min over partitions seen
    before b of their max event time, minus the delay; T1 decides."""
    seen, late, wm = {}, set(), None
    w = cfg.window_minutes * 60_000
    for b in sorted({r["seq"] // PER_BATCH for r in rows}):
        batch = [r for r in rows if r["seq"] // PER_BATCH == b]
        if seen:
            low = min(seen.values()) - cfg.watermark_seconds * 1000
            wm = low if wm is None else max(wm, low)
        for r in batch:
            end = (r["timestamp_ms"] // w) * w + w
            if wm is not None and end + cfg.allowed_lateness_seconds * 1000 <= wm:
                late.add((r["click_id"], r["seq"]))
        for r in batch:
            seen[r["part"]] = max(seen.get(r["part"], r["timestamp_ms"]), r["timestamp_ms"])
    return late


def test_stream_equals_batch(spark, tmp):
    cfg = JobConfig()
    arr = derived.with_arrival(derived.load_clicks(spark, SF001)).select(*SCHEMA.fieldNames())
    rows = [r.asDict() for r in arr.collect()]  # test fixture: 1,100 rows
    src = os.path.join(tmp, "events")
    os.makedirs(src)
    for b in sorted({r["seq"] // PER_BATCH for r in rows}):
        p = os.path.join(src, f"b{b:05d}.json")
        with open(p, "w") as f:
            for r in sorted((r for r in rows if r["seq"] // PER_BATCH == b), key=lambda r: r["seq"]):
                f.write(json.dumps(r) + "\n")
        os.utime(p, (1e9 + b, 1e9 + b))

    events = file_stream(spark, src, SCHEMA, "json", max_files_per_trigger=1)
    split = os.path.join(tmp, "split")
    start_splitter(events, split, os.path.join(tmp, "ck1"), cfg, part_col="part",
                   trigger={"availableNow": True}, tables=MinuteTables(os.path.join(tmp, "tables"), cfg)).awaitTermination(300)
    late = {(r.click_id, r.seq) for r in spark.read.parquet(f"{split}/late").collect()}
    assert late == expected_late(rows, cfg)
    assert len(late) > 0

    tables = os.path.join(tmp, "tables")
    key = ["window_start_ms", "ad_id", "country", "device_type"]
    stream = read_minutes(spark, tables).withColumn("window_start_ms", F.unix_millis("window_start")).select(*key, "advertiser_id", "click_count",
                                                F.col("unique_sessions").alias("est"))
    batch = window_aggregate(spark.read.parquet(f"{split}/accepted"), "1 minute", exact_sessions=True) \
        .select(*key, "advertiser_id", "click_count", "unique_sessions")
    s = {tuple(r[k] for k in key): (r.advertiser_id, r.click_count, r.est) for r in stream.collect()}
    b = {tuple(r[k] for k in key): (r.advertiser_id, r.click_count, r.unique_sessions) for r in batch.collect()}
    assert s.keys() == b.keys()
    for k in s:
        assert s[k][:2] == b[k][:2]
        assert abs(s[k][2] - b[k][2]) <= max(1, 0.03 * b[k][2])
    # accepted + late = every arrival
    n_acc = spark.read.parquet(f"{split}/accepted").count()
    n_late = spark.read.parquet(f"{split}/late").count()
    assert n_acc + n_late == len(rows)


def test_audit_equals_the_stream_record_by_record(spark, tmp):
    """STR-7: the batch audit marks the records that the splitter rejects when each
    record is a micro-batch of its own, over two source partitions."""
    from clickwise.operators.lateness import lateness_audit
    from clickwise.streaming.splitter import LateSplitter
    t0 = 1_704_067_200_000
    times = [(0, 5), (1, 70), (0, 80), (1, 130), (0, 15), (0, 140), (1, 40), (0, 55), (1, 175), (0, 200), (1, 61), (0, 119)]
    rows = [(f"c{i}", "ad-1", "adv-1", None, "s", "h", "ua", "US", "DESKTOP", t0 + sec * 1000, part, i)
            for i, (part, sec) in enumerate(times)]
    df = spark.createDataFrame(rows, SCHEMA)
    audit = lateness_audit(df, n_parts=2, tiebreak="click_id")
    expect = {r.click_id for r in audit.filter("is_late").collect()}
    splitter = LateSplitter(os.path.join(tmp, "s"), JobConfig(), part_col="part", clock=lambda: 0, keep_accepted=False)
    for i, r in enumerate(rows):
        splitter(spark.createDataFrame([r], SCHEMA), i)
    got = {r.click_id for r in spark.read.parquet(os.path.join(tmp, "s", "late")).collect()}
    assert got == expect and got


def test_audit_equals_the_stream_when_a_partition_idles_and_returns(spark, tmp):
    """Partition 1 is silent for eleven minutes of processing time, then sends what it held."""
    from clickwise.operators.lateness import lateness_audit
    from clickwise.streaming.splitter import LateSplitter
    t0 = 1_704_067_200_000
    # (source partition, event second, processing second)
    sent = [(0, 10, 0), (1, 20, 1), (0, 100, 60), (1, 90, 61), (0, 400, 300), (0, 500, 362), (0, 700, 700), (0, 760, 715), (1, 95, 720), (1, 200, 721),
            (0, 800, 722), (1, 690, 723), (1, 820, 724), (0, 620, 725), (1, 640, 726)]
    rows = [(f"c{i}", "ad-1", "adv-1", None, "s", "h", "ua", "US", "DESKTOP", t0 + sec * 1000, part, i) for i, (part, sec, _) in enumerate(sent)]
    df = spark.createDataFrame([(*r, t * 1000) for r, (_, _, t) in zip(rows, sent)], T.StructType(SCHEMA.fields + [T.StructField("arrived_ms", T.LongType())]))
    audit = lateness_audit(df, n_parts=2, tiebreak="click_id", arrived="arrived_ms", chunk=3).collect()
    clock = {"now": 0}
    splitter = LateSplitter(os.path.join(tmp, "s"), JobConfig(), part_col="part", clock=lambda: clock["now"], keep_accepted=False)
    marks = {}
    for i, r in enumerate(rows):
        clock["now"] = sent[i][2] * 1000
        marks[r[0]] = splitter.watermark_ms(spark, i)
        splitter(spark.createDataFrame([r], SCHEMA), i)
    assert {r.click_id: r.watermark_ms for r in audit} == marks
    late = {r.click_id for r in spark.read.parquet(os.path.join(tmp, "s", "late")).collect()}
    assert {r.click_id for r in audit if r.is_late} == late == {"c8", "c9", "c11", "c13", "c14"}
