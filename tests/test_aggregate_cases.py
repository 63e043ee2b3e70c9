"""Windowed aggregation on small hand-made inputs."""

from pyspark.sql import types as T

from clickwise.operators import aggregate as agg
from clickwise.schemas import CLICK_EVENT

NOON = 1_709_294_400_000  # 2024-03-01 12:00:00 UTC


def click(cid, at=0, ad="banner", adv="north", sess="s1", country="DE", device="MOBILE"):
    return (cid, ad, adv, None, sess, "hash", "agent", country, device, NOON + at)


def rows_of(spark, clicks, exact=True, **kw):
    return agg.window_aggregate(spark.createDataFrame(clicks, CLICK_EVENT), "1 minute", exact_sessions=exact, **kw).collect()


def one(spark, clicks, **kw):
    out = rows_of(spark, clicks, **kw)
    assert len(out) == 1
    return out[0]


def test_empty_table(spark):
    assert rows_of(spark, []) == []


def test_half_open_minutes(spark):
    out = rows_of(spark, [click("p", 0), click("q", 59_999), click("r", 60_000)])
    assert sorted((r.window_start_ms - NOON, r.window_end_ms - NOON, r.click_count) for r in out) == [(0, 60_000, 2), (60_000, 120_000, 1)]


def test_repeats_of_an_id_count_once_per_window(spark):
    out = rows_of(spark, [click("k", t) for t in (0, 7, 59_000, 61_000)])
    assert sorted((r.window_start_ms - NOON, r.click_count) for r in out) == [(0, 1), (60_000, 1)]


def test_sessions_exact_and_estimated(spark):
    clicks = [click(f"k{i}", i, sess=f"visit-{i % 5}") for i in range(23)]
    assert one(spark, clicks).unique_sessions == 5
    assert one(spark, clicks, exact=False).unique_sessions == 5


def test_null_sessions_are_no_session(spark):
    r = one(spark, [click("a", sess=None), click("b", 1, sess=None), click("c", 2, sess="x")])
    assert (r.click_count, r.unique_sessions) == (3, 1)
    assert one(spark, [click("a", sess=None)], exact=False).unique_sessions == 0


def test_missing_country_and_device_share_a_group(spark):
    r = one(spark, [click("a", country=None), click("b", 1, country="UNKNOWN"), click("c", 2, country=None)])
    assert (r.country, r.device_type, r.click_count) == ("UNKNOWN", "MOBILE", 3)


def test_advertiser_of_the_earliest_click(spark):
    late_first = [click("z", 30, adv="south"), click("b", 10, adv="west"), click("a", 10, adv="east"), click("c", 40, adv="south")]
    assert one(spark, late_first).advertiser_id == "east"   # time, then click id
    assert one(spark, late_first, exact=False).advertiser_id == "east"


def test_groups_by_ad_country_and_device(spark):
    out = rows_of(spark, [click("a"), click("b", 1, ad="video"), click("c", 2, country="FR"), click("d", 3, device="TABLET"), click("e", 4)])
    assert sorted((r.ad_id, r.country, r.device_type, r.click_count) for r in out) == [
        ("banner", "DE", "MOBILE", 2), ("banner", "DE", "TABLET", 1), ("banner", "FR", "MOBILE", 1), ("video", "DE", "MOBILE", 1)]


def test_three_partials_merge_into_one_value(spark):
    schema = T.StructType(CLICK_EVENT.fields + [T.StructField("shard", T.IntegerType())])
    spread = [(click("m1", 5, sess="u"), 0), (click("m2", 6, sess="v"), 0), (click("m2", 6, sess="v"), 1),
              (click("m3", 2, sess="w", adv="late"), 1), (click("m1", 5, sess="u"), 2), (click("m4", 9, sess=None), 2)]
    df = spark.createDataFrame([c + (s,) for c, s in spread], schema)
    out = agg.merge_partials(*agg.partial_states(df, "1 minute", by=("shard",))).collect()
    assert [(r.click_count, r.unique_sessions, r.advertiser_id) for r in out] == [(4, 3, "late")]
