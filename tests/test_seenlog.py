"""The bucketed log of seen ids: what it drops, what its plan moves, replays and expiry."""

import random

from clickwise.operators.dedup import DAY_MS
from clickwise.operators.seenlog import SeenLog, buckets_for

HOUR = 3_600_000
BATCH = "event_id long, click_id string, batch_start_ms long, extra string"


def passes(spark, rows):
    return spark.createDataFrame(rows, "click_id string, timestamp_ms long, note string")


def test_equals_a_scan_over_batches_and_sessions(spark, tmp):
    rnd = random.Random(5)
    logged = [[(f"c{rnd.randrange(60)}", day * DAY_MS + rnd.randrange(DAY_MS), "x") for _ in range(80)] for day in range(4)]
    for day, rows in enumerate(logged):
        SeenLog(spark, f"{tmp}/log", buckets=4 + day).append(passes(spark, rows + [(None, 5, "x"), ("c1", None, "x")]), day)
    log = SeenLog(spark, f"{tmp}/log", buckets=99)
    assert log.buckets == 4 and log.ids().count() == 320
    batch = [(i, rnd.choice([None, "", *(f"c{k}" for k in range(70))]), rnd.randrange(6) * DAY_MS // 2, "e") for i in range(300)]
    got = log.drop_seen(spark.createDataFrame(batch, BATCH))
    sights = [(c, t) for rows in logged for c, t, _ in rows]
    want = {i for i, c, start, _ in batch if not any(c == k and start - DAY_MS < t < start for k, t in sights)}
    assert got.columns == ["event_id", "click_id", "batch_start_ms", "extra"]
    assert sorted(r.event_id for r in got.collect()) == sorted(want) and 0 < len(want) < 300


def test_the_log_is_not_shuffled_and_other_days_are_not_read(spark, tmp):
    log = SeenLog(spark, f"{tmp}/log", buckets=8)
    for day in range(3):
        log.append(passes(spark, [(f"c{k}", day * DAY_MS + k, "x") for k in range(50)]), day)
    batch = spark.createDataFrame([(k, f"c{k}", 2 * DAY_MS, "e") for k in range(80)], BATCH)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = log.drop_seen(batch)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.event_id for r in kept.collect()) == [0, *range(50, 80)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # one exchange, the batch's; the log is read by buckets
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("FileScan")
    assert "Bucketed: true" in plan and "seen_day" in plan[plan.index("PartitionFilters"):]


def test_a_batch_again_expiry_and_empty_tables(spark, tmp):
    log = SeenLog(spark, f"{tmp}/log", buckets=2)
    batch = spark.createDataFrame([(1, "a", DAY_MS, "e"), (2, "b", DAY_MS, "e")], BATCH)
    assert log.drop_seen(batch).count() == 2 and log.drop_seen(batch.limit(0)).count() == 0
    log.append(passes(spark, [("a", HOUR, "x"), ("b", HOUR, "x")]), 7)
    log.append(passes(spark, [("a", HOUR, "x")]), 7)  # the batch again, now without b
    log.append(passes(spark, [("z", 3 * DAY_MS, "x")]), 8)
    log.append(passes(spark, []), 9)
    assert [r.event_id for r in log.drop_seen(batch).collect()] == [2]
    assert log.forget(DAY_MS - 1) == [] and log.forget(DAY_MS) == [0]
    assert [r.click_id for r in log.ids().collect()] == ["z"] and log.drop_seen(batch).count() == 2


def test_number_of_buckets():
    assert buckets_for(0) == 1 and buckets_for(10_000_000) == 3 and buckets_for(10**13) == 20_000
