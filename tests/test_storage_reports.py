"""Versioned log, latest-wins, sum collapse, table layout, compaction,
retention and reports over written tables."""

import datetime as dt

from pyspark.sql import functions as F

from clickwise.operators import rollup, storage
from clickwise.operators.retention import expired_months, retained
from clickwise.plans import report
from clickwise.sinks.tables import apply_retention, write_minute_table, write_rollup_table
from clickwise.sources import derived
from clickwise.operators.aggregate import window_aggregate
from tests.conftest import SF001

LOG_SCHEMA = ("window_start_ms long, ad_id string, country string, device_type string, advertiser_id string, "
              "click_count long, unique_sessions long, batch_id long, emit_seq long")


def test_latest_wins_picks_highest_version(spark):
    rows = [(0, "ad-1", "US", "DESKTOP", "adv-1", 1, 1, 0, 0), (0, "ad-1", "US", "DESKTOP", "adv-1", 3, 2, 2, 0),
            (0, "ad-1", "US", "DESKTOP", "adv-1", 2, 2, 1, 5), (60000, "ad-1", "US", "DESKTOP", "adv-1", 7, 1, 0, 0)]
    log = spark.createDataFrame(rows, LOG_SCHEMA)
    key = ("window_start_ms", "ad_id", "country", "device_type")
    a = sorted(tuple(r) for r in storage.latest_wins(log, key=key).select(*key, "click_count", "batch_id").collect())
    assert a == [(0, "ad-1", "US", "DESKTOP", 3, 2), (60000, "ad-1", "US", "DESKTOP", 7, 0)]


def test_sum_collapse_drops_all_zero_keys(spark):
    df = spark.createDataFrame([("k", 1, 1), ("k", 2, 0), ("z", 0, 0)], "k string, click_count long, unique_sessions long")
    assert sorted(tuple(r) for r in storage.sum_collapse(df, ["k"]).collect()) == [("k", 3, 1)]


def test_version_log_resolves_to_the_minute_rows(spark):
    minutes = window_aggregate(derived.load_clicks(spark, SF001), "1 minute", exact_sessions=True)
    log = derived.version_log(minutes)
    key = ("window_start_ms", "ad_id", "country", "device_type")
    cols = [*key, "advertiser_id", "click_count", "unique_sessions"]
    latest = storage.latest_wins(log, key=key)
    assert sorted(map(tuple, latest.select(*cols).collect())) == sorted(map(tuple, minutes.select(*cols).collect()))
    per_key = log.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("advertiser_id").alias("advs"))
    assert {r.n for r in per_key.select("n").distinct().collect()} == {1, 2, 3}
    assert per_key.filter("n > 1 AND advs > 1").count() > 0
    h_latest, _ = rollup.rollups(log, "latest")
    # T4: adding every version up would count windows that were emitted again more than once
    assert log.agg(F.sum("click_count")).first()[0] > h_latest.agg(F.sum("click_count")).first()[0]
    for a, b in zip(rollup.rollups(log, "latest"), rollup.rollups(log, "deltas")):
        assert sorted(map(tuple, a.select(*sorted(a.columns)).collect())) == sorted(map(tuple, b.select(*sorted(b.columns)).collect()))


def test_advertiser_filter_sees_only_current_rows(spark, tmp):
    """A key whose advertiser changes from one version to the next belongs to the last one."""
    t = dt.datetime(2024, 1, 5, 10, 0)
    rows = [(t, "ad-1", "adv-1", "US", "DESKTOP", 3, 1, 0, 0), (t, "ad-1", "adv-2", "US", "DESKTOP", 4, 1, 1, 0)]
    df = spark.createDataFrame(rows, "window_start timestamp, ad_id string, advertiser_id string, country string, device_type string, "
                                     "click_count long, unique_sessions long, batch_id long, emit_seq long")
    write_minute_table(df, f"{tmp}/clicks_1min")

    def clicks(**kw):
        return [r.click_count for r in report.click_report(spark, tmp, "minute", **kw).collect()]
    assert clicks() == [4] and clicks(advertiser_id="adv-1") == [] and clicks(advertiser_id="adv-2") == [4]


def test_writing_part_of_a_month_keeps_the_rest(spark, tmp):
    m = _minutes(spark)
    day = F.dayofmonth("window_start")
    path = f"{tmp}/clicks_1min"
    write_minute_table(m.filter(day == 1), path)
    write_minute_table(m.filter(day == 2), path)
    write_minute_table(m.filter(day == 2), path)  # again: replaces its own rows
    assert spark.read.parquet(path).count() == m.filter(day <= 2).count()
    hours = rollup.hourly(m.withColumn("window_start_ms", F.unix_millis("window_start")))
    hour_day = F.dayofmonth(F.timestamp_millis("window_hour_ms"))
    for d in (1, 2, 2):
        write_rollup_table(hours.filter(hour_day == d), f"{tmp}/clicks_hourly", "window_hour")
    assert spark.read.parquet(f"{tmp}/clicks_hourly").count() == hours.filter(hour_day <= 2).count()


def test_half_done_swap_is_undone(spark, tmp):
    from clickwise.sources import fs
    path = f"{tmp}/clicks_1min"
    m = _minutes(spark)
    write_minute_table(m, path)
    import os
    os.rename(f"{path}/month=202401", f"{path}/_old_month=202401")  # a crash between the two renames
    fs.recover(spark, path)
    assert spark.read.parquet(path).count() == m.count()


def test_load_sees_appended_rows(spark, tmp):
    from clickwise.sources.tables import load
    spark.range(10).write.parquet(f"{tmp}/t.parquet")
    assert load(spark, tmp, "t").count() == 10
    spark.range(15).write.mode("append").parquet(f"{tmp}/t.parquet")
    assert load(spark, tmp, "t").count() == 25


def _minutes(spark):
    clicks = derived.load_clicks(spark, SF001)
    return window_aggregate(clicks, "1 minute", exact_sessions=True) \
        .select("window_start", "ad_id", "advertiser_id", "country", "device_type", "click_count",
                "unique_sessions") \
        .withColumn("batch_id", F.lit(0).cast("long")).withColumn("emit_seq", F.lit(0).cast("long"))


def test_table_layout_and_report_prunes_months(spark, tmp):
    base = f"{tmp}/tables"
    m = _minutes(spark)
    write_minute_table(m, f"{base}/clicks_1min")
    back = spark.read.parquet(f"{base}/clicks_1min")
    assert back.select("month").distinct().collect()[0][0] == 202401
    hours = rollup.hourly(m.withColumn("window_start_ms", F.unix_millis("window_start")))
    write_rollup_table(hours, f"{base}/clicks_hourly", "window_hour")
    write_rollup_table(rollup.daily(hours), f"{base}/clicks_daily", "window_day")
    rep = report.click_report(spark, base, "hour", advertiser_id="adv-1", start="2024-01-05", end="2024-01-06")
    plan = rep._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "month" in plan
    assert "PushedFilters" in plan and "advertiser_id" in plan
    expect = m.filter((F.col("advertiser_id") == "adv-1") & (F.col("window_start") >= "2024-01-05")
                      & (F.col("window_start") < "2024-01-06")).agg(F.sum("click_count")).first()[0]
    assert rep.agg(F.sum("click_count")).first()[0] == expect
    day = report.click_report(spark, base, "day").agg(F.sum("click_count")).first()[0]
    minute = report.click_report(spark, base, "minute").agg(F.sum("click_count")).first()[0]
    assert day == minute == m.agg(F.sum("click_count")).first()[0]


def test_compaction_keeps_latest_rows(spark, tmp):
    path = f"{tmp}/clicks_1min"
    m = _minutes(spark)
    older = m.withColumn("click_count", F.col("click_count") + 100).withColumn("batch_id", F.lit(-1).cast("long"))
    write_minute_table(m.unionByName(older), path)
    assert storage.compact_months(spark, path) == [202401]
    back = spark.read.parquet(path)
    assert back.count() == m.count()
    assert back.agg(F.sum("click_count")).first()[0] == m.agg(F.sum("click_count")).first()[0]


def test_compaction_refuses_a_streaming_table(spark, tmp):
    import pytest
    spark.createDataFrame([(1, 202401, 0)], "x int, month int, batch_id int").write.partitionBy("month", "batch_id").parquet(f"{tmp}/t")
    with pytest.raises(ValueError, match="streaming job"):
        storage.compact_months(spark, f"{tmp}/t")


def test_retention(spark, tmp):
    rows = [(dt.datetime(2023, 12, 31, 23, 0), "a"), (dt.datetime(2024, 1, 10), "b"), (dt.datetime(2024, 2, 1), "c")]
    df = spark.createDataFrame(rows, "window_start timestamp, ad_id string") \
        .withColumn("advertiser_id", F.lit("adv")).withColumn("country", F.lit("US")) \
        .withColumn("device_type", F.lit("DESKTOP")).withColumn("click_count", F.lit(1).cast("long")) \
        .withColumn("unique_sessions", F.lit(1).cast("long"))
    kept = retained(df, "window_start", "2026-01-10 00:00:00")
    assert sorted(r.ad_id for r in kept.collect()) == ["c"]
    path = f"{tmp}/t"
    write_minute_table(df, path)
    touched = apply_retention(spark, path, "window_start", "2026-01-10 00:00:00")
    assert touched == [202312, 202401]
    assert sorted(r.ad_id for r in spark.read.parquet(path).collect()) == ["c"]
    assert expired_months([202312, 202401, 202402], "2026-01-10 00:00:00") == [202312]
    plan = retained(spark.read.parquet(path), "window_start", "2026-01-10 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(window_start" in plan  # the cut-off reaches the scan


def test_head_rows_is_top_n(spark):
    m = _minutes(spark).withColumn("window_start_ms", F.unix_millis("window_start"))
    top = report.head_rows(m, 10)
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()
    assert top.count() == 10
    assert report.as_json_lines(top).first()[0].startswith("{")


def test_cli_report_and_retention(spark, tmp):
    from clickwise.__main__ import main
    base = f"{tmp}/tables"
    write_minute_table(_minutes(spark), f"{base}/clicks_1min")
    out = f"{tmp}/rep"
    assert main(["report", "--tables", base, "--grain", "minute", "--advertiser", "adv-1", "--out", out],
                spark=spark) == 0
    lines = spark.read.text(out).collect()
    assert lines and all('"advertiser_id":"adv-1"' in r.value for r in lines)
    assert main(["retention", "--table", f"{base}/clicks_1min", "--now", "2026-01-15 00:00:00"], spark=spark) == 0
    left = spark.read.parquet(f"{base}/clicks_1min")
    assert left.agg(F.min("window_start")).first()[0] > dt.datetime(2024, 1, 15)


def test_report_ad_filter_and_breakdown(spark, tmp):
    base = f"{tmp}/tables"
    m = _minutes(spark)
    write_minute_table(m, f"{base}/clicks_1min")
    rep = report.click_report(spark, base, "minute", ad_ids=["ad-1", "ad-6"], by=("advertiser_id", "ad_id"))
    got = {(r.ad_id, r.advertiser_id) for r in rep.select("ad_id", "advertiser_id").distinct().collect()}
    assert got and {a for a, _ in got} <= {"ad-1", "ad-6"} and {adv for _, adv in got} == {"adv-1", "adv-2"}
    want = m.filter(F.col("ad_id").isin("ad-1", "ad-6")).agg(F.sum("click_count")).first()[0]
    assert rep.agg(F.sum("click_count")).first()[0] == want
