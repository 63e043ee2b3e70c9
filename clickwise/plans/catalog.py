"""The engine's named queries (one per operator of the inventory) and their
DuckDB oracles.  Importing this module fills ``REGISTRY``.

Every query reads the driver's tables in full (or views Spark derives from
them, see ``clickwise.sources.derived``); timestamps leave as epoch-ms longs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickwise.functions import (
    device_type_from_ua, extract_client_ip, geo_country_stub, hash_ip, is_blank,
    time_bucket_5s, to_start_of_day, to_start_of_hour, to_yyyymm,
)
from clickwise.functions import late_text as late_text_col
from clickwise.operators import aggregate as agg
from clickwise.operators import dedup, enrich, lateness, rollup, storage
from clickwise.operators.georanges import range_country
from clickwise.operators.retention import retained
from clickwise.operators.seenlog import SeenLog
from clickwise.plans import report, sqlparts as sp
from clickwise.plans.registry import register, with_ctes
from clickwise.session import SHUFFLE_PARTITIONS, ensure_checkpoint_dir
from clickwise.sinks import messages
from clickwise.sinks.tables import write_minute_table, write_rollup_table
from clickwise.sources import derived
from clickwise.sources.derived import CLICKS_SQL
from clickwise.sources.tables import load

MINUTE_COLS = ["window_start_ms", "window_end_ms", "ad_id", "advertiser_id", "country",
               "device_type", "click_count", "unique_sessions"]
KEYS = ["ad_id", "country", "device_type"]
HOUR_MS = 3_600_000
DAY_MS = 86_400_000
# Arrivals per partial state, and the retention clock of the
# registered retention query.
BATCH_SIZE = 64
RETENTION_NOW = "2026-01-20 00:00:00"


def _requests(spark, sf_dir):
    return derived.load_requests(spark, sf_dir)


def _ingested(spark, sf_dir):
    return enrich.ingest(_requests(spark, sf_dir), keep=("event_id",))


def _arrivals(spark, sf_dir):
    return derived.with_arrival(agg.normalize_keys(_clicks(spark, sf_dir)))


def _minute_log(spark, sf_dir):
    return derived.version_log(agg.window_aggregate(_clicks(spark, sf_dir), "1 minute", exact_sessions=True))


def _latest_minutes(spark, sf_dir):
    return storage.latest_wins(_minute_log(spark, sf_dir), key=("window_start_ms", *KEYS))


def _sql(*ctes, body: str) -> str:
    return with_ctes(*ctes) + "\n" + body


def _clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.load_clicks(spark, sf_dir)


# ------------------------------------------------------------- minute agg --

@register("minute_agg", _sql(CLICKS_SQL, body=sp.minute_agg_body("clicks", 60_000)))
def minute_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-1/3/4, STR-4/8, PRJ-3/4/8: 1-minute tumbling windows per (ad, country,
    device) with distinct clicks, exact distinct sessions, advertiser pick."""
    out = agg.window_aggregate(_clicks(spark, sf_dir), "1 minute", exact_sessions=True)
    return out.select(*MINUTE_COLS)


# ============================================================ scalar / FN ==

@register("click_id_resolution", _sql(sp.REQUESTS_SQL, body=f"""
SELECT event_id, ad_id, ts_ms, click_id AS click_id_in,
       CASE WHEN {sp.blank('click_id')} THEN {sp.uuid_of('sha256(' + sp.CLICK_SEED + ')')}
            ELSE click_id END AS click_id,
       {sp.blank('click_id')} AS generated_id
FROM requests"""))
def click_id_resolution(spark, sf_dir):
    """FN-1, FN-2, FLT-3: client id kept untrimmed, else SHA-256 id of the 5 s bucket."""
    r = _requests(spark, sf_dir)
    return enrich.resolve_ids(r.withColumn("click_id_in", F.col("click_id"))) \
        .select("event_id", "ad_id", "ts_ms", "click_id_in", "click_id", "generated_id")


@register("client_ip", _sql(sp.REQUESTS_SQL, body=f"""
SELECT event_id, x_forwarded_for, x_real_ip, remote_addr, {sp.client_ip()} AS client_ip
FROM requests"""))
def client_ip(spark, sf_dir):
    """FN-3: first X-Forwarded-For hop, else X-Real-IP, else remote address."""
    return _requests(spark, sf_dir).select(
        "event_id", "x_forwarded_for", "x_real_ip", "remote_addr",
        extract_client_ip("x_forwarded_for", "x_real_ip", "remote_addr").alias("client_ip"))


@register("device_type", _sql(sp.REQUESTS_SQL, body=f"""
SELECT event_id, user_agent, {sp.device('user_agent')} AS device_type FROM requests"""))
def device_type(spark, sf_dir):
    """FN-4: tablet markers before mobile markers; blank -> UNKNOWN."""
    return _requests(spark, sf_dir).select("event_id", "user_agent",
                                           device_type_from_ua("user_agent").alias("device_type"))


@register("blank_check", _sql(sp.REQUESTS_SQL, body=f"""
SELECT event_id, {sp.blank('click_id')} AS click_id_blank, {sp.blank('x_forwarded_for')} AS xff_blank,
       {sp.blank('user_agent')} AS user_agent_blank, {sp.blank('x_real_ip')} AS real_ip_blank
FROM requests"""))
def blank_check(spark, sf_dir):
    """FLT-3: null-or-blank predicate on the request fields."""
    return _requests(spark, sf_dir).select(
        "event_id", is_blank("click_id").alias("click_id_blank"),
        is_blank("x_forwarded_for").alias("xff_blank"), is_blank("user_agent").alias("user_agent_blank"),
        is_blank("x_real_ip").alias("real_ip_blank"))


@register("geo_stub", _sql(sp.REQUESTS_SQL, body=f"""
SELECT event_id, client_ip, {sp.geo_stub('client_ip')} AS country
FROM (SELECT event_id, {sp.client_ip()} AS client_ip FROM requests)"""))
def geo_stub(spark, sf_dir):
    """FN-5: stub country rule on the client IP."""
    ip = extract_client_ip("x_forwarded_for", "x_real_ip", "remote_addr")
    return _requests(spark, sf_dir).select("event_id", ip.alias("client_ip")) \
        .select("event_id", "client_ip", geo_country_stub("client_ip").alias("country"))


@register("hash_ip", _sql(sp.REQUESTS_SQL, body=f"""
SELECT event_id, client_ip,
       CASE WHEN {sp.blank('client_ip')} THEN 'unknown' ELSE sha256(client_ip) END AS hashed_ip
FROM (SELECT event_id, {sp.client_ip()} AS client_ip FROM requests)"""))
def hash_ip_q(spark, sf_dir):
    """FN-6: unsalted SHA-256 of the client IP; blank -> 'unknown'."""
    ip = extract_client_ip("x_forwarded_for", "x_real_ip", "remote_addr")
    return _requests(spark, sf_dir).select("event_id", ip.alias("client_ip")) \
        .select("event_id", "client_ip", hash_ip("client_ip").alias("hashed_ip"))


@register("redirect_url", _sql(sp.REQUESTS_SQL, body=f"""
SELECT event_id, ad_id, {sp.redirect('ad_id')} AS redirect_url FROM requests"""))
def redirect_url_q(spark, sf_dir):
    """FN-7: stub destination URL."""
    return _requests(spark, sf_dir).select("event_id", "ad_id").transform(enrich.stub_destination) \
        .withColumnRenamed("destination_url", "redirect_url")


@register("time_functions", _sql(CLICKS_SQL, body="""
SELECT click_id, event_id, timestamp_ms,
       timestamp_ms // 5000 AS bucket_5s,
       (timestamp_ms // 3600000) * 3600000 AS hour_start_ms,
       (timestamp_ms // 86400000) * 86400000 AS day_start_ms,
       CAST(year(epoch_ms(timestamp_ms)) * 100 + month(epoch_ms(timestamp_ms)) AS INTEGER) AS month
FROM clicks"""))
def time_functions(spark, sf_dir):
    """FN-2, FN-8..FN-11: bucket, hour/day start, month partition of each click."""
    et = F.timestamp_millis("timestamp_ms")
    return _clicks(spark, sf_dir).select(
        "click_id", "event_id", "timestamp_ms", time_bucket_5s("timestamp_ms").alias("bucket_5s"),
        F.unix_millis(to_start_of_hour(et)).alias("hour_start_ms"),
        F.unix_millis(to_start_of_day(et)).alias("day_start_ms"),
        to_yyyymm(et).alias("month"))


# ============================================================ enrichment ==

_GEO_SQL = f""",
geo AS (SELECT CAST(n_nationkey AS BIGINT) * 10 * 16777216 AS ip_from,
               (CAST(n_nationkey AS BIGINT) + 1) * 10 * 16777216 - 1 AS ip_to,
               n_name AS geo_country FROM nation),
ips AS (SELECT event_id, client_ip, {sp.ipv4_num('client_ip')} AS ip_num
        FROM (SELECT event_id, {sp.client_ip()} AS client_ip FROM requests))"""


@register("geo_range_join", _sql(sp.REQUESTS_SQL + _GEO_SQL, body="""
SELECT i.event_id, i.client_ip, i.ip_num, g.geo_country AS country
FROM ips i LEFT JOIN geo g ON i.ip_num BETWEEN g.ip_from AND g.ip_to"""))
def geo_range_join(spark, sf_dir):
    """JN-1: client IP -> country by IPv4 range table (derived from ``nation``)."""
    geo = enrich.geo_ranges_from_nation(load(spark, sf_dir, "nation", ["n_nationkey", "n_name"]))
    ip = extract_client_ip("x_forwarded_for", "x_real_ip", "remote_addr")
    df = _requests(spark, sf_dir).select("event_id", ip.alias("raw_ip"))
    return df.transform(range_country(geo)) \
        .select("event_id", F.col("raw_ip").alias("client_ip"), "ip_num", "country")


@register("geo_nested_ranges", "WITH " + derived.NESTED_RANGES_SQL + """
SELECT a.event_id, a.client_ip,
       (SELECT arg_min(r.country, (r.high - r.low, r.country)) FROM nested r
        WHERE r.family = a.family AND a.n BETWEEN r.low AND r.high) AS country
FROM addresses a""")
def geo_nested_ranges(spark, sf_dir):
    """JN-1: IPv4 and IPv6 addresses by ranges that nest and overlap; the narrowest one names the country."""
    return (derived.load_addresses(spark, sf_dir).transform(range_country(derived.load_nested_ranges(spark, sf_dir)))
            .select("event_id", F.col("raw_ip").alias("client_ip"), "country"))


@register("ad_dim_join", _sql(sp.REQUESTS_SQL, body=f"""
SELECT r.event_id, r.ad_id,
       coalesce(r.advertiser_id, 'adv-' || (p.p_partkey % 5), 'unknown') AS advertiser_id,
       coalesce('https://shop.example/p/' || p.p_partkey, {sp.redirect('r.ad_id')}) AS destination_url
FROM requests r LEFT JOIN part p ON r.ad_id = 'ad-' || p.p_partkey AND p.p_partkey % 7 <> 3"""))
def ad_dim_join(spark, sf_dir):
    """JN-2 / UDX-4: ad dimension lookup (derived from ``part``, every 7th ad is
    not in it) with defaults."""
    ads = enrich.ads_from_part(load(spark, sf_dir, "part", ["p_partkey"]).filter("p_partkey % 7 != 3"))
    return _requests(spark, sf_dir).select("event_id", "ad_id", "advertiser_id") \
        .transform(enrich.ad_dimension(ads)).select("event_id", "ad_id", "advertiser_id", "destination_url")


_EVENT_COLS = ["click_id", "ad_id", "advertiser_id", "placement_id", "session_id", "hashed_ip",
               "user_agent", "country", "device_type", "timestamp_ms", "event_id"]


@register("event_projection", _sql(sp.INGEST_SQL, body="SELECT * FROM ingested"))
def event_projection(spark, sf_dir):
    """PRJ-1/2/6/7, UDX-3/5: the ordered enrichment chain, raw IP never projected."""
    return _ingested(spark, sf_dir).select(*_EVENT_COLS)


_EVENT_JSON_SQL = "CAST(json_object(" + ", ".join(f"'{c}', {c}" for c in _EVENT_COLS[:-1]) + ") AS VARCHAR)"


@register("event_messages", _sql(sp.INGEST_SQL, body=f"""
SELECT event_id, ad_id AS key, {_EVENT_JSON_SQL} AS value FROM ingested"""))
def event_messages(spark, sf_dir):
    """SNK-4: click events keyed by ad id (same ad -> same stream partition), JSON value."""
    return messages.event_messages(_ingested(spark, sf_dir), fields=_EVENT_COLS[:-1], keep=("event_id",))


# ================================================================= dedup ==

_DEDUP_SQL = "WITH RECURSIVE " + sp.INGEST_SQL.strip() + """,
passes(click_id, pass_ts) AS (
  SELECT click_id, min(timestamp_ms) FROM ingested GROUP BY click_id
  UNION ALL
  SELECT i.click_id, min(i.timestamp_ms) FROM ingested i JOIN passes p
    ON i.click_id = p.click_id AND i.timestamp_ms >= p.pass_ts + 86400000
  GROUP BY i.click_id
),
kept AS (
  SELECT i.*, row_number() OVER (PARTITION BY i.click_id, i.timestamp_ms ORDER BY i.event_id) AS rn
  FROM ingested i JOIN passes p ON i.click_id = p.click_id AND i.timestamp_ms = p.pass_ts
)"""


@register("dedup_24h", _DEDUP_SQL + "\nSELECT * EXCLUDE (rn) FROM kept WHERE rn = 1")
def dedup_24h(spark, sf_dir):
    """DED-1 / FLT-1 batch form: first sight of a click id per 24 h period passes."""
    return dedup.first_sight(_ingested(spark, sf_dir).select(*_EVENT_COLS), tiebreak=("event_id",))


@register("dedup_counts", _DEDUP_SQL + """
SELECT CAST((SELECT count(*) FROM kept WHERE rn = 1) AS BIGINT) AS published,
       CAST((SELECT count(*) FROM ingested) - (SELECT count(*) FROM kept WHERE rn = 1) AS BIGINT) AS duplicates""")
def dedup_counts(spark, sf_dir):
    """FLT-4: published / duplicate counters of the 24 h dedup."""
    ev = _ingested(spark, sf_dir).select(*_EVENT_COLS)
    return dedup.dedup_counts(ev, dedup.first_sight(ev, tiebreak=("event_id",)))


_SEEN_SQL = _DEDUP_SQL + """,
seen AS (SELECT click_id, timestamp_ms AS seen_ms FROM kept WHERE rn = 1),
batches AS (SELECT event_id, click_id, timestamp_ms, (timestamp_ms // 86400000) * 86400000 AS batch_start_ms
            FROM ingested)
SELECT * FROM batches b
WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.click_id = b.click_id
                  AND s.seen_ms > b.batch_start_ms - 86400000 AND s.seen_ms < b.batch_start_ms)"""


@register("dedup_vs_seen", _SEEN_SQL)
def dedup_vs_seen(spark, sf_dir):
    """JN-3: daily request batches anti-joined with the ids seen (passed) in
    the 24 h before each batch starts."""
    ev = _ingested(spark, sf_dir).select(*_EVENT_COLS)
    seen = dedup.first_sight(ev, tiebreak=("event_id",)).select("click_id", F.col("timestamp_ms").alias("seen_ms"))
    batch = ev.select("event_id", "click_id", "timestamp_ms",
                      (F.floor(F.col("timestamp_ms") / DAY_MS) * DAY_MS).cast("long").alias("batch_start_ms"))
    return dedup.anti_join_seen_batches(batch, seen)


@register("dedup_seen_log", _SEEN_SQL)
def dedup_seen_log(spark, sf_dir):
    """JN-3 by the stored log: passed ids are written to a log bucketed by id, which the
    daily batches are joined with where it lies."""
    ev = _ingested(spark, sf_dir).select(*_EVENT_COLS)
    log = SeenLog(spark, f"{ensure_checkpoint_dir(spark)}/seen-{uuid.uuid4().hex}", int(spark.conf.get(SHUFFLE_PARTITIONS)))
    log.append(dedup.first_sight(ev, tiebreak=("event_id",)), 0)
    return log.drop_seen(ev.select("event_id", "click_id", "timestamp_ms",
                                   (F.floor(F.col("timestamp_ms") / DAY_MS) * DAY_MS).cast("long").alias("batch_start_ms")))


# ============================================================ aggregates ==

@register("window_agg_1h", _sql(CLICKS_SQL, body=sp.minute_agg_body("clicks", HOUR_MS)))
def window_agg_1h(spark, sf_dir):
    """STR-4 with a configured window size (60 minutes)."""
    return agg.window_aggregate(_clicks(spark, sf_dir), "60 minutes", exact_sessions=True).select(*MINUTE_COLS)


MONTH_MS = 30 * DAY_MS


@register("minute_agg_hll_check", _sql(CLICKS_SQL, body=f"""
SELECT (timestamp_ms // {MONTH_MS}) * {MONTH_MS} AS window_start_ms, coalesce(device_type, 'UNKNOWN') AS device_type,
       count(DISTINCT click_id) AS click_count, first(advertiser_id ORDER BY timestamp_ms, click_id) AS advertiser_id,
       count(DISTINCT session_id) AS unique_sessions, TRUE AS hll_within_bound
FROM clicks GROUP BY 1, 2"""))
def minute_agg_hll_check(spark, sf_dir):
    """AGG-2 / UDX-1: HLL (p=14) session estimate of large groups (30-day windows per
    device) within 3 % of the exact count."""
    clicks = _clicks(spark, sf_dir)
    est = agg.window_aggregate(clicks, "30 days", exact_sessions=False, keys=("device_type",))
    exact = (agg.normalize_keys(clicks).groupBy((F.floor(F.col("timestamp_ms") / MONTH_MS) * MONTH_MS).cast("long").alias("window_start_ms"),
                                                "device_type").agg(F.count_distinct("session_id").alias("exact")))
    ok = F.abs(F.col("unique_sessions") - F.col("exact")) <= 0.03 * F.col("exact")
    return est.join(exact, ["window_start_ms", "device_type"]).select(
        "window_start_ms", "device_type", "click_count", "advertiser_id", F.col("exact").alias("unique_sessions"), ok.alias("hll_within_bound"))


@register("advertiser_pick", _sql(sp.INGEST_SQL, body=f"""
SELECT (timestamp_ms // {HOUR_MS}) * {HOUR_MS} AS window_start_ms, ad_id,
       coalesce(country, 'UNKNOWN') AS country, coalesce(device_type, 'UNKNOWN') AS device_type,
       first(advertiser_id ORDER BY timestamp_ms, click_id) AS advertiser_id,
       count(DISTINCT advertiser_id) AS n_advertisers
FROM ingested GROUP BY 1, 2, 3, 4"""))
def advertiser_pick(spark, sf_dir):
    """AGG-3 (T7): advertiser of the earliest event when a window mixes values."""
    ev = agg.normalize_keys(_ingested(spark, sf_dir))
    w = F.window(F.timestamp_millis("timestamp_ms"), "60 minutes")
    return (ev.groupBy(w.alias("window"), *KEYS)
              .agg(agg.advertiser_pick(), F.count_distinct("advertiser_id").alias("n_advertisers"))
              .select(F.unix_millis("window.start").alias("window_start_ms"), *KEYS, "advertiser_id", "n_advertisers"))


@register("partial_merge", _sql(sp.ARRIVALS_SQL, body=f"""
SELECT (timestamp_ms // {HOUR_MS}) * {HOUR_MS} AS window_start_ms, ad_id, country, device_type,
       first(advertiser_id ORDER BY timestamp_ms, click_id) AS advertiser_id,
       count(DISTINCT click_id) AS click_count, TRUE AS sessions_within_bound
FROM arrivals GROUP BY 1, 2, 3, 4"""))
def partial_merge(spark, sf_dir):
    """AGG-5/AGG-6: per-micro-batch partial states (id set, sketch, first
    event) merged into the window's value."""
    arr = _arrivals(spark, sf_dir).withColumn("batch", F.floor(F.col("seq") / BATCH_SIZE))
    ids, sketches = agg.partial_states(arr, "60 minutes", by=("batch",))
    merged = agg.merge_partials(ids, sketches)
    exact = agg.normalize_keys(arr).withColumn("window_start", F.window(F.timestamp_millis("timestamp_ms"),
                                                                         "60 minutes").start) \
        .groupBy("window_start", *KEYS).agg(F.count_distinct("session_id").alias("_exact"))
    ok = F.abs(F.col("unique_sessions") - F.col("_exact")) <= 0.03 * F.col("_exact")
    return merged.join(exact, ["window_start", *KEYS]).select(
        F.unix_millis("window_start").alias("window_start_ms"), *KEYS, "advertiser_id", "click_count",
        ok.alias("sessions_within_bound"))


# ===================================================== versioned storage ==

@register("minute_log", _sql(CLICKS_SQL + sp.version_log(), body="SELECT * FROM minute_log"))
def minute_log(spark, sf_dir):
    """STR-5 / SNK-1 rows: the stored versions of every minute row."""
    return _minute_log(spark, sf_dir)


@register("latest_wins", _sql(CLICKS_SQL + sp.version_log(), body="""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY window_start_ms, ad_id, country, device_type
                               ORDER BY batch_id DESC, emit_seq DESC) AS rn FROM minute_log) WHERE rn = 1"""))
def latest_wins(spark, sf_dir):
    """AGG-7 / SRC-4 / DED-3: latest version per minute key of the log."""
    return _latest_minutes(spark, sf_dir)


_LATEST_CTE = CLICKS_SQL + sp.version_log() + """,
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY window_start_ms, ad_id, country, device_type
                                 ORDER BY batch_id DESC, emit_seq DESC) AS rn
    FROM minute_log) WHERE rn = 1
),
hourly AS (
  SELECT (window_start_ms // 3600000) * 3600000 AS window_hour_ms, advertiser_id, ad_id, country, device_type,
         CAST(sum(click_count) AS BIGINT) AS click_count, CAST(sum(unique_sessions) AS BIGINT) AS unique_sessions
  FROM latest GROUP BY 1, 2, 3, 4, 5
),
daily AS (
  SELECT (window_hour_ms // 86400000) * 86400000 AS window_day_ms, advertiser_id, ad_id, country, device_type,
         CAST(sum(click_count) AS BIGINT) AS click_count, CAST(sum(unique_sessions) AS BIGINT) AS unique_sessions
  FROM hourly GROUP BY 1, 2, 3, 4, 5
)"""


@register("hourly_rollup", _sql(_LATEST_CTE, body="SELECT * FROM hourly"))
def hourly_rollup(spark, sf_dir):
    """AGG-8 (latest mode): hourly sums of the latest minute rows."""
    h, _ = rollup.rollups(_minute_log(spark, sf_dir), "latest")
    return h


@register("daily_rollup", _sql(_LATEST_CTE, body="SELECT * FROM daily"))
def daily_rollup(spark, sf_dir):
    """AGG-9 (latest mode): daily sums of the hourly rows."""
    _, d = rollup.rollups(_minute_log(spark, sf_dir), "latest")
    return d


def _latest_rollup_sql(width_ms: int, out: str) -> str:
    return _sql(_LATEST_CTE, body=f"""
SELECT (window_start_ms // {width_ms}) * {width_ms} AS {out}, advertiser_id, ad_id, country, device_type,
       CAST(sum(click_count) AS BIGINT) AS click_count, CAST(sum(unique_sessions) AS BIGINT) AS unique_sessions
FROM latest GROUP BY 1, 2, 3, 4, 5""")


@register("rollup_insert_sum", _latest_rollup_sql(HOUR_MS, "window_hour_ms"))
def rollup_insert_sum(spark, sf_dir):
    """STR-12: hours from inserted rows alone: each version's values less those of the version it
    replaces, summed.  Windows emitted again (T4) count once, so the result is that of the
    latest versions."""
    h, _ = rollup.rollups(_minute_log(spark, sf_dir), "deltas")
    return h


@register("sum_collapse", _latest_rollup_sql(DAY_MS, "window_day_ms"))
def sum_collapse(spark, sf_dir):
    """AGG-10: each batch's daily deltas, rows of one sort key collapsed into their sums and
    keys whose sums are zero (an advertiser that lost its rows) gone."""
    _, d = rollup.rollups(_minute_log(spark, sf_dir), "deltas")
    return d


# Micro-batches of the streamed_* queries; the tables are compacted after the first two.
STREAMED_BATCHES, COMPACT_AFTER = 3, 2


def _streamed_tables(spark: SparkSession, sf_dir: str) -> str:
    """The clicks in arrival order through the streaming job's tables; returns their base path."""
    from clickwise.streaming.minutes import MinuteTables, compact_tables
    base = f"{ensure_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"
    arrivals, tables = _arrivals(spark, sf_dir), MinuteTables(base)
    last = arrivals.agg(F.max("seq")).first()[0]
    for b in range(STREAMED_BATCHES if last is not None else 0):
        tables(arrivals.filter(F.expr(f"seq * {STREAMED_BATCHES} div {last + 1} = {b}")).drop("seq", "part", "arrived_ms", "event_id"), b)
        if b + 1 == COMPACT_AFTER:
            compact_tables(spark, base)
    return base


def _streamed_sql(width_ms: int, out: str) -> str:
    return _sql(CLICKS_SQL, body=f"""
SELECT (window_start_ms // {width_ms}) * {width_ms} AS {out}, advertiser_id, ad_id, country, device_type,
       CAST(sum(click_count) AS BIGINT) AS click_count
FROM ({sp.minute_agg_body('clicks', 60_000)}) m GROUP BY 1, 2, 3, 4, 5""")


@register("streamed_minutes", _sql(CLICKS_SQL, body=f"""
SELECT window_start_ms, ad_id, advertiser_id, country, device_type, click_count FROM ({sp.minute_agg_body('clicks', 60_000)}) m"""))
def streamed_minutes(spark, sf_dir):
    """STR-5/STR-10, AGG-11: minute rows out of micro-batches whose tables are compacted between them."""
    from clickwise.streaming.minutes import read_minutes
    return read_minutes(spark, _streamed_tables(spark, sf_dir)).select(
        F.unix_millis("window_start").alias("window_start_ms"), "ad_id", "advertiser_id", "country", "device_type", "click_count")


@register("streamed_hours", _streamed_sql(HOUR_MS, "window_hour_ms"))
def streamed_hours(spark, sf_dir):
    """STR-12, AGG-10/11: hours kept by difference over micro-batches, compacted between them."""
    from clickwise.streaming.minutes import read_rollup
    return read_rollup(spark, _streamed_tables(spark, sf_dir), "hourly").select(
        F.unix_millis("window_hour").alias("window_hour_ms"), "advertiser_id", *KEYS, "click_count")


@register("rollup_sessions_merged_check", _sql(CLICKS_SQL, body="""
SELECT (mins.m // 3600000) * 3600000 AS window_hour_ms, advertiser_id, ad_id, country, device_type,
       count(DISTINCT (mins.m, session_id)) FILTER (session_id IS NOT NULL) AS unique_sessions,
       count(DISTINCT session_id) AS unique_sessions_exact, TRUE AS est_within_bound
FROM (SELECT (timestamp_ms // 60000) * 60000 AS m, ad_id, coalesce(country, 'UNKNOWN') AS country,
             coalesce(device_type, 'UNKNOWN') AS device_type,
             first(advertiser_id ORDER BY timestamp_ms, click_id) AS advertiser_id
      FROM clicks GROUP BY 1, 2, 3, 4) mins
JOIN (SELECT (timestamp_ms // 60000) * 60000 AS m, ad_id, coalesce(country, 'UNKNOWN') AS country,
             coalesce(device_type, 'UNKNOWN') AS device_type, session_id FROM clicks) c USING (m, ad_id, country, device_type)
GROUP BY 1, 2, 3, 4, 5"""))
def rollup_sessions_merged_check(spark, sf_dir):
    """AGG-12 / T5: hourly sessions — summed minute values (reference) vs merged
    sketches (within 3 % of the exact distinct count of the same minutes)."""
    clicks = _clicks(spark, sf_dir)
    minutes = agg.window_aggregate(clicks, "1 minute", exact_sessions=True, with_sketch=True)
    merged = rollup.merged_sessions(minutes, "hour")
    minute = ["window_start_ms", *KEYS]
    sessions = (agg.normalize_keys(clicks).filter(F.col("session_id").isNotNull())
                .select((F.floor(F.col("timestamp_ms") / 60_000) * 60_000).cast("long").alias("window_start_ms"), *KEYS, "session_id").distinct())
    hour = ["window_hour_ms", "advertiser_id", *KEYS]
    exact = (sessions.join(minutes.select(*minute, "advertiser_id"), minute)
             .withColumn("window_hour_ms", (F.floor(F.col("window_start_ms") / HOUR_MS) * HOUR_MS).cast("long"))
             .groupBy(*hour).agg(F.count_distinct("session_id").alias("unique_sessions_exact")))
    j = merged.join(exact, hour, "left") \
        .withColumn("unique_sessions_exact", F.coalesce("unique_sessions_exact", F.lit(0).cast("long")))
    ok = F.abs(F.col("unique_sessions_est") - F.col("unique_sessions_exact")) <= 0.03 * F.col("unique_sessions_exact")
    return j.select("window_hour_ms", "advertiser_id", *KEYS, "unique_sessions", "unique_sessions_exact",
                    ok.alias("est_within_bound"))


# ============================================================== lateness ==

# One row per arrival and source partition that has sent something before it; the
# partitions silent for over 300 s (against the newest arrival) are left out.
_AUDIT_SQL = sp.ARRIVALS_SQL + f""",
numbered AS (SELECT *, row_number() OVER (ORDER BY seq, event_id, part) AS nr FROM arrivals),
sources AS (SELECT DISTINCT part AS source FROM arrivals),
heard AS (
  SELECT nr, source, max(CASE WHEN part = source THEN timestamp_ms END) OVER earlier AS top,
         max(CASE WHEN part = source THEN arrived_ms END) OVER earlier AS last_ms
  FROM numbered CROSS JOIN sources
  WINDOW earlier AS (PARTITION BY source ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
awake AS (SELECT *, max(last_ms) OVER (PARTITION BY nr) - last_ms <= 300000 AS is_awake FROM heard WHERE last_ms IS NOT NULL),
lows AS (SELECT nr, min(top) FILTER (is_awake) AS low FROM awake GROUP BY nr),
audit AS (
  SELECT event_id, click_id, ad_id, part, seq, timestamp_ms,
         (timestamp_ms // {HOUR_MS}) * {HOUR_MS} + {HOUR_MS} AS window_end_ms,
         max(low) OVER (ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS max_before_ms
  FROM numbered LEFT JOIN lows USING (nr)
)"""


def _audit(spark, sf_dir):
    return lateness.lateness_audit(_arrivals(spark, sf_dir), derived.N_SOURCE_PARTS, window_ms=HOUR_MS, arrived="arrived_ms")


@register("lateness_audit", _sql(_AUDIT_SQL, body="""
SELECT event_id, click_id, part, seq, timestamp_ms, window_end_ms, max_before_ms,
       coalesce(window_end_ms + 30000 <= max_before_ms - 10000, FALSE) AS is_late
FROM audit"""))
def lateness_audit(spark, sf_dir):
    """STR-1/2/7 / T1: replay of the arrival order; late iff window end + 30 s <= watermark: the
    highest, so far, of the least max event time over the source partitions that are not
    idle, less 10 s.  1 h windows."""
    return _audit(spark, sf_dir).select("event_id", "click_id", "part", "seq", "timestamp_ms", "window_end_ms",
                      "max_before_ms", "is_late")


@register("late_text", _sql(_AUDIT_SQL, body="""
SELECT event_id, 'LATE:' || click_id || ' adId=' || ad_id AS value
FROM audit WHERE window_end_ms + 30000 <= max_before_ms - 10000"""))
def late_text(spark, sf_dir):
    """PRJ-5 / SNK-2: text records of the late clicks."""
    return _audit(spark, sf_dir).filter("is_late").select("event_id", late_text_col("click_id", "ad_id").alias("value"))


# ========================================================= retention etc ==

_MINUTE_LATEST_SQL = CLICKS_SQL + sp.version_log() + """,
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY window_start_ms, ad_id, country, device_type
                                 ORDER BY batch_id DESC, emit_seq DESC) AS rn
    FROM minute_log) WHERE rn = 1
)"""


@register("retention", _sql(_MINUTE_LATEST_SQL, body=f"""
SELECT * FROM latest
WHERE epoch_ms(window_start_ms) + INTERVAL 2 YEAR > TIMESTAMP '{RETENTION_NOW}'"""))
def retention(spark, sf_dir):
    """SNK-7: rows whose window start + 2 years is after the (parameter) clock."""
    return retained(_latest_minutes(spark, sf_dir), "window_start_ms", RETENTION_NOW, is_ms=True)


# ============================================================== reports ==

def _report_sql(period: str, src: str, where: str = "TRUE") -> str:
    return _sql(_LATEST_CTE, body=f"""
SELECT advertiser_id, {period}, CAST(sum(click_count) AS BIGINT) AS click_count, CAST(sum(unique_sessions) AS BIGINT) AS unique_sessions
FROM {src} WHERE {where} GROUP BY 1, 2""")


def _stored_tables(spark: SparkSession, sf_dir: str, grain: str) -> str:
    """Write the table of a grain (SNK-5, SNK-6) to the shared folder; returns its base path."""
    base = f"{ensure_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"
    if grain == "minute":
        write_minute_table(_minute_log(spark, sf_dir), f"{base}/clicks_1min")
        return base
    hours, days = rollup.rollups(_minute_log(spark, sf_dir), "latest")
    if grain == "hour":
        write_rollup_table(hours, f"{base}/clicks_hourly", "window_hour")
    else:
        write_rollup_table(days, f"{base}/clicks_daily", "window_day")
    return base


def _report(spark: SparkSession, sf_dir: str, grain: str, **filters) -> DataFrame:
    col = report.GRAINS[grain]
    rep = report.click_report(spark, _stored_tables(spark, sf_dir, grain), grain, **filters)
    return rep.withColumn(f"{col}_ms", F.unix_millis(col)).drop(col)


# The filters of the report_filtered queries.
REPORT_FILTERS = {"advertiser_id": "adv-1", "ad_ids": ["ad-1", "ad-5", "ad-6", "ad-11", "ad-16"],
                  "start": "2024-01-05 00:00:00", "end": "2024-01-20 00:00:00"}


def _filter_sql(col: str) -> str:
    f = REPORT_FILTERS
    ads = ", ".join(f"'{a}'" for a in f["ad_ids"])
    return (f"advertiser_id = '{f['advertiser_id']}' AND ad_id IN ({ads}) AND epoch_ms({col}) >= TIMESTAMP '{f['start']}' "
            f"AND epoch_ms({col}) < TIMESTAMP '{f['end']}'")


@register("report_minute", _report_sql("window_start_ms", "latest"))
def report_minute(spark, sf_dir):
    """RPT-1 / SNK-5 at minute grain: versions stored, read back latest-wins, all advertisers."""
    return _report(spark, sf_dir, "minute")


@register("report_hour", _report_sql("window_hour_ms", "hourly"))
def report_hour(spark, sf_dir):
    """RPT-1 / SRC-6 / SNK-6 at hour grain."""
    return _report(spark, sf_dir, "hour")


@register("report_day", _report_sql("window_day_ms", "daily"))
def report_day(spark, sf_dir):
    """RPT-1 / SRC-6 / SNK-6 at day grain."""
    return _report(spark, sf_dir, "day")


@register("report_filtered_minute", _report_sql("window_start_ms", "latest", _filter_sql("window_start_ms")))
def report_filtered_minute(spark, sf_dir):
    """RPT-1 at minute grain for one advertiser, some ads and a time range; the
    advertiser of many rows changed between versions."""
    return _report(spark, sf_dir, "minute", **REPORT_FILTERS)


@register("report_filtered_hour", _report_sql("window_hour_ms", "hourly", _filter_sql("window_hour_ms")))
def report_filtered_hour(spark, sf_dir):
    """RPT-1 at hour grain with the same filters."""
    return _report(spark, sf_dir, "hour", **REPORT_FILTERS)


@register("report_filtered_day", _report_sql("window_day_ms", "daily", _filter_sql("window_day_ms")))
def report_filtered_day(spark, sf_dir):
    """RPT-1 at day grain with the same filters."""
    return _report(spark, sf_dir, "day", **REPORT_FILTERS)


# The three days of the report_sessions_merged query.
MERGED_RANGE = ("2024-01-05 00:00:00", "2024-01-08 00:00:00")


@register("report_sessions_merged", _sql(CLICKS_SQL, body=f"""
SELECT advertiser_id, count(DISTINCT click_id) AS click_count, count(DISTINCT session_id) AS unique_sessions_exact, TRUE AS est_within_bound
FROM (SELECT (timestamp_ms // 60000) * 60000 AS m, ad_id, coalesce(country, 'UNKNOWN') AS country,
             coalesce(device_type, 'UNKNOWN') AS device_type,
             first(advertiser_id ORDER BY timestamp_ms, click_id) AS advertiser_id
      FROM clicks GROUP BY 1, 2, 3, 4) mins
JOIN (SELECT (timestamp_ms // 60000) * 60000 AS m, ad_id, coalesce(country, 'UNKNOWN') AS country,
             coalesce(device_type, 'UNKNOWN') AS device_type, session_id, click_id FROM clicks) c USING (m, ad_id, country, device_type)
WHERE epoch_ms(m) >= TIMESTAMP '{MERGED_RANGE[0]}' AND epoch_ms(m) < TIMESTAMP '{MERGED_RANGE[1]}' GROUP BY 1"""))
def report_sessions_merged(spark, sf_dir):
    """AGG-12 + RPT-1: distinct sessions of each advertiser over three days, from the hourly
    sketches stored by the streaming job, within 3 % of the exact count."""
    rep = report.click_report(spark, _streamed_tables(spark, sf_dir), "day", start=MERGED_RANGE[0], end=MERGED_RANGE[1],
                              sessions="merged", per_period=False)
    clicks = agg.normalize_keys(_clicks(spark, sf_dir)).withColumn("m", (F.floor(F.col("timestamp_ms") / 60_000) * 60_000).cast("long"))
    at = F.timestamp_millis("m")
    here = clicks.filter((at >= F.lit(MERGED_RANGE[0]).cast("timestamp")) & (at < F.lit(MERGED_RANGE[1]).cast("timestamp")))
    owner = here.groupBy("m", *KEYS).agg(agg.advertiser_pick())
    exact = (here.drop("advertiser_id").join(owner, ["m", *KEYS]).groupBy("advertiser_id")
                 .agg(F.count_distinct("session_id").alias("unique_sessions_exact")))
    ok = F.abs(F.col("unique_sessions") - F.col("unique_sessions_exact")) <= 0.03 * F.col("unique_sessions_exact")
    return rep.join(exact, "advertiser_id").select("advertiser_id", "click_count", "unique_sessions_exact", ok.alias("est_within_bound"))


@register("limit10", _sql(_MINUTE_LATEST_SQL, body="""
SELECT * FROM latest ORDER BY window_start_ms, ad_id, country, device_type LIMIT 10"""))
def limit10(spark, sf_dir):
    """SRC-5 / SRT-2: ``LIMIT 10`` of the minute table in a stable order."""
    return report.head_rows(_latest_minutes(spark, sf_dir), 10)


@register("aggregated_json", _sql(CLICKS_SQL, body=f"""
SELECT ad_id AS key,
       CAST(json_object('window_start_ms', window_start_ms, 'window_end_ms', window_end_ms, 'ad_id', ad_id,
                        'advertiser_id', advertiser_id, 'country', country, 'device_type', device_type,
                        'click_count', click_count, 'unique_sessions', unique_sessions) AS VARCHAR) AS value
FROM ({sp.minute_agg_body('clicks', 60000)}) a"""))
def aggregated_json(spark, sf_dir):
    """SNK-3: aggregates as key = ad id, value = JSON."""
    return messages.aggregate_messages(minute_agg(spark, sf_dir))
