"""Click-stream inputs derived from the driver's ``events`` table.

Two views, each given once as DataFrame code (what the engine runs) and once
as SQL text (what the DuckDB oracle runs):

* ``clicks``         — click events as they arrive on the raw-click stream
                       (already enriched), including exact replays.
* ``click_requests`` — raw intake requests (before enrichment), including
                       replays and ids that come again hours later, for the
                       ingest path.

and one of stored rows:

* ``version_log``    — minute rows with earlier versions (``version_log``).

Replays: every event whose id is a multiple of 10 arrives twice.  This is how
duplicates enter the data; every row of ``events`` is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clickwise.sources.tables import load

# Deterministic rules that turn events into clicks.
N_ADS = 20
N_ADVERTISERS = 5
REPLAY_EVERY = 10
NO_SESSION_EVERY = 11
NO_ADVERTISER_EVERY = 13

# User agents of the request log, picked by event_id % 7.
USER_AGENTS = (
    "Mozilla/5.0 (iPad; CPU OS 17_0 like Mac OS X) Mobile/15E148",
    "Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 Mobile Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36",
    None,
    "\t ",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X)",
    "Mozilla/5.0 (Linux; Android 13; KFTRWI) Kindle Silk",
)

EVENT_COLUMNS = ["event_id", "ts", "user_id"]


def _s(c: Column) -> Column:
    return c.cast("string")


def _ts_ms() -> Column:
    return F.unix_millis(F.col("ts").cast("timestamp"))


# Click ids that come again, by event_id % 50, and after how many hours.
RECUR_EVERY = 50
RECUR_AFTER_HOURS = {7: 1, 17: 20, 27: 25}
# Every 9th click belongs to another advertiser than its ad's; a
# session covers the clicks of a user with the same event_id % 400.
OTHER_ADVERTISER_EVERY = 9
SESSION_SPREAD = 400


def _with_replays(events: DataFrame) -> DataFrame:
    """Every REPLAY_EVERY-th event arrives twice: one scan, a generator emits
    the copy (same result as a union with the filtered table, half the reads)."""
    copies = F.when(F.col("event_id") % REPLAY_EVERY == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return events.withColumn("_copy", F.explode(copies)).drop("_copy")


def _pick(key: Column, values) -> Column:
    out = None
    for i, v in enumerate(values):
        lit = F.lit(v).cast("string")
        out = F.when(key == i, lit) if out is None else out.when(key == i, lit)
    return out


# ---------------------------------------------------------------- clicks ---

def clicks_from_events(events: DataFrame) -> DataFrame:
    """Click events (CLICK_EVENT schema) from ``events``, replays included."""
    uid, eid = F.col("user_id"), F.col("event_id")
    ua = _pick(eid % 6, (USER_AGENTS[0], USER_AGENTS[1], USER_AGENTS[2], "", USER_AGENTS[5], USER_AGENTS[6]))
    device = (F.when(eid % 6 == 3, F.lit("UNKNOWN"))
               .when((eid % 6 == 0) | (eid % 6 == 5), F.lit("TABLET"))
               .when((eid % 6 == 1) | (eid % 6 == 4), F.lit("MOBILE"))
               .otherwise(F.lit("DESKTOP")))
    out = events.select(
        F.concat(F.lit("c-"), _s(eid)).alias("click_id"),
        F.concat(F.lit("ad-"), _s(uid % N_ADS)).alias("ad_id"),
        F.concat(F.lit("adv-"), _s((uid + F.when(eid % OTHER_ADVERTISER_EVERY == 0, 1).otherwise(0)) % N_ADVERTISERS)).alias("advertiser_id"),
        F.when(uid % 3 != 0, F.concat(F.lit("pl-"), _s(uid % 3))).alias("placement_id"),
        F.when(uid % NO_SESSION_EVERY != 0, F.concat(F.lit("sess-"), _s(uid), F.lit("-"), _s(eid % SESSION_SPREAD))).alias("session_id"),
        F.sha2(F.concat(F.lit("203.0.113."), _s(uid % 256)), 256).alias("hashed_ip"),
        ua.alias("user_agent"),
        F.when(uid % 7 == 0, F.lit(None).cast("string"))
         .when(uid % 7 == 1, F.lit("IN")).otherwise(F.lit("US")).alias("country"),
        device.alias("device_type"),
        _ts_ms().alias("timestamp_ms"),
        eid.alias("event_id"),
    )
    return _with_replays(out)


def load_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks_from_events(load(spark, sf_dir, "events", EVENT_COLUMNS))


_UA_SQL = "\n".join(
    f"      WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("\t", "' || chr(9) || '") + "'")
    for i, v in enumerate(USER_AGENTS))

CLICKS_SQL = f"""
clicks_base AS (
  SELECT 'c-' || event_id AS click_id,
         'ad-' || (user_id % {N_ADS}) AS ad_id,
         'adv-' || ((user_id + CASE WHEN event_id % {OTHER_ADVERTISER_EVERY} = 0 THEN 1 ELSE 0 END) % {N_ADVERTISERS}) AS advertiser_id,
         CASE WHEN user_id % 3 <> 0 THEN 'pl-' || (user_id % 3) END AS placement_id,
         CASE WHEN user_id % {NO_SESSION_EVERY} <> 0 THEN 'sess-' || user_id || '-' || (event_id % {SESSION_SPREAD}) END AS session_id,
         sha256('203.0.113.' || (user_id % 256)) AS hashed_ip,
         CASE event_id % 6
           WHEN 0 THEN '{USER_AGENTS[0]}' WHEN 1 THEN '{USER_AGENTS[1]}' WHEN 2 THEN '{USER_AGENTS[2]}'
           WHEN 3 THEN '' WHEN 4 THEN '{USER_AGENTS[5]}' ELSE '{USER_AGENTS[6]}' END AS user_agent,
         CASE user_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'IN' ELSE 'US' END AS country,
         CASE WHEN event_id % 6 = 3 THEN 'UNKNOWN'
              WHEN event_id % 6 IN (0, 5) THEN 'TABLET'
              WHEN event_id % 6 IN (1, 4) THEN 'MOBILE' ELSE 'DESKTOP' END AS device_type,
         epoch_us(ts) // 1000 AS timestamp_ms,
         event_id
  FROM events
),
clicks AS (
  SELECT * FROM clicks_base
  UNION ALL
  SELECT * FROM clicks_base WHERE event_id % {REPLAY_EVERY} = 0
)"""


# -------------------------------------------------------- click requests ---

def requests_from_events(events: DataFrame) -> DataFrame:
    """Raw click requests (CLICK_REQUEST schema) from ``events``, replays included."""
    uid, eid = F.col("user_id"), F.col("event_id")
    ip_tail = _s(uid % 256)
    click_id = (F.when(eid % 8 == 0, F.lit(None).cast("string"))
                 .when(eid % 8 == 1, F.lit(" "))
                 .when(eid % 8 == 2, F.lit("\t"))
                 .otherwise(F.concat(F.lit("c-"), _s(eid))))
    xff = (F.when(eid % 5 == 0, F.concat(F.lit("203.0.113."), ip_tail, F.lit(", 10.0.0.1")))
            .when(eid % 5 == 1, F.lit(None).cast("string"))
            .when(eid % 5 == 2, F.lit("  "))
            .when(eid % 5 == 3, F.concat(F.lit(" 10.1.2."), ip_tail))
            .otherwise(F.lit(",198.51.100.7")))
    out = events.select(
        F.concat(F.lit("ad-"), _s(uid % N_ADS)).alias("ad_id"),
        click_id.alias("click_id"),
        F.when(uid % 3 != 0, F.concat(F.lit("pl-"), _s(uid % 3))).alias("placement_id"),
        F.when(uid % NO_SESSION_EVERY != 0, F.concat(F.lit("sess-"), _s(uid))).alias("session_id"),
        F.when(uid % NO_ADVERTISER_EVERY != 0, F.concat(F.lit("adv-"), _s(uid % N_ADVERTISERS))).alias("advertiser_id"),
        _pick(eid % 7, USER_AGENTS).alias("user_agent"),
        xff.alias("x_forwarded_for"),
        F.when(eid % 3 != 0, F.concat(F.lit(" 192.168.1."), ip_tail, F.lit(" "))).alias("x_real_ip"),
        F.when(uid % 2 == 0, F.lit("127.0.0.1")).otherwise(F.concat(F.lit("172.16.0."), ip_tail)).alias("remote_addr"),
        _ts_ms().alias("ts_ms"),
        eid.alias("event_id"),
    )
    again = F.array().cast("array<long>")
    for rest, hours in RECUR_AFTER_HOURS.items():
        again = F.when(eid % RECUR_EVERY == rest, F.array(F.lit(hours * 3_600_000).cast("long"))).otherwise(again)
    after = F.concat(F.array(F.lit(0).cast("long")), again)
    return (_with_replays(out).withColumn("_after", F.explode(after))
            .withColumn("ts_ms", F.col("ts_ms") + F.col("_after")).drop("_after"))


def load_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_from_events(load(spark, sf_dir, "events", EVENT_COLUMNS))


_RECUR_SQL = "\n".join(
    f"  UNION ALL SELECT * REPLACE (ts_ms + {h * 3_600_000} AS ts_ms) FROM requests_twice WHERE event_id % {RECUR_EVERY} = {r}"
    for r, h in RECUR_AFTER_HOURS.items())

REQUESTS_SQL = f"""
requests_base AS (
  SELECT 'ad-' || (user_id % {N_ADS}) AS ad_id,
         CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN chr(9)
              ELSE 'c-' || event_id END AS click_id,
         CASE WHEN user_id % 3 <> 0 THEN 'pl-' || (user_id % 3) END AS placement_id,
         CASE WHEN user_id % {NO_SESSION_EVERY} <> 0 THEN 'sess-' || user_id END AS session_id,
         CASE WHEN user_id % {NO_ADVERTISER_EVERY} <> 0 THEN 'adv-' || (user_id % {N_ADVERTISERS}) END AS advertiser_id,
         CASE event_id % 7
{_UA_SQL}
         END AS user_agent,
         CASE event_id % 5 WHEN 0 THEN '203.0.113.' || (user_id % 256) || ', 10.0.0.1'
              WHEN 1 THEN NULL WHEN 2 THEN '  ' WHEN 3 THEN ' 10.1.2.' || (user_id % 256)
              ELSE ',198.51.100.7' END AS x_forwarded_for,
         CASE WHEN event_id % 3 <> 0 THEN ' 192.168.1.' || (user_id % 256) || ' ' END AS x_real_ip,
         CASE WHEN user_id % 2 = 0 THEN '127.0.0.1' ELSE '172.16.0.' || (user_id % 256) END AS remote_addr,
         epoch_us(ts) // 1000 AS ts_ms,
         event_id
  FROM events
),
requests_twice AS (
  SELECT * FROM requests_base
  UNION ALL
  SELECT * FROM requests_base WHERE event_id % {REPLAY_EVERY} = 0
),
requests AS (
  SELECT * FROM requests_twice
{_RECUR_SQL}
)"""


# ------------------------------------------------------- arrival order ---

# Late-arrival model.  Every 7th event arrives 40 positions late;
# arrivals come from 4 source partitions, keyed by ad (ad number % 4, which
# equals user_id % 4 because 4 divides the number of ads).  One position is one
# second.  Of every 1,500 positions partition 3 is silent for 600 (longer than the
# idle timeout) and then delivers what it held.
LATE_SHIFT = 40
LATE_EVERY = 7
N_SOURCE_PARTS = 4
SILENT_PART, SILENT_EVERY, SILENT_FOR = 3, 1500, 600
POSITION_MS = 1000


def with_arrival(clicks: DataFrame) -> DataFrame:
    """Adds ``seq`` (arrival position), ``part`` (source partition) and ``arrived_ms`` (processing time)."""
    eid = F.col("event_id")
    late = eid + F.when(eid % LATE_EVERY == 0, LATE_SHIFT).otherwise(0)
    part = ad_number(F.col("ad_id")) % N_SOURCE_PARTS
    held = (part == SILENT_PART) & (late % SILENT_EVERY < SILENT_FOR)
    seq = F.when(held, late - late % SILENT_EVERY + SILENT_FOR).otherwise(late)
    return clicks.withColumn("seq", seq).withColumn("part", part).withColumn("arrived_ms", F.col("seq") * POSITION_MS)


def ad_number(ad_id: Column) -> Column:
    return F.substring_index(ad_id, "-", -1).cast("long")


_LATE_SQL = f"(event_id + CASE WHEN event_id % {LATE_EVERY} = 0 THEN {LATE_SHIFT} ELSE 0 END)"
_PART_SQL = f"(CAST(split_part(ad_id, '-', 2) AS BIGINT) % {N_SOURCE_PARTS})"
_SEQ_SQL = (f"(CASE WHEN {_PART_SQL} = {SILENT_PART} AND {_LATE_SQL} % {SILENT_EVERY} < {SILENT_FOR} "
            f"THEN {_LATE_SQL} - {_LATE_SQL} % {SILENT_EVERY} + {SILENT_FOR} ELSE {_LATE_SQL} END)")
ARRIVAL_SQL_COLUMNS = f"{_SEQ_SQL} AS seq, {_PART_SQL} AS part, {_SEQ_SQL} * {POSITION_MS} AS arrived_ms"


# --------------------------------------------------------- version log ---

def version_log(minutes: DataFrame) -> DataFrame:
    """Minute rows as stored over time: an ad's rows have one to three versions
    (ad number % 3 + 1).  The last version holds the row's values; one that is j
    versions older counts j clicks more and names the advertiser j further on."""
    ad = ad_number(F.col("ad_id"))
    older = ad % 3 - F.col("batch_id")
    return (minutes.withColumn("batch_id", F.explode(F.sequence(F.lit(0).cast("long"), ad % 3)))
                   .select("window_start_ms", "ad_id", "country", "device_type",
                           F.concat(F.lit("adv-"), _s((ad_number(F.col("advertiser_id")) + older) % N_ADVERTISERS)).alias("advertiser_id"),
                           (F.col("click_count") + older).alias("click_count"), "unique_sessions", "batch_id",
                           F.lit(0).cast("long").alias("emit_seq")))


def version_log_sql(minutes: str) -> str:
    """CTE ``minute_log`` over the query ``minutes``."""
    return f""",
minute_rows AS ({minutes}),
versions AS (SELECT *, CAST(split_part(ad_id, '-', 2) AS BIGINT) % 3 AS last,
                    unnest(range(0, CAST(split_part(ad_id, '-', 2) AS BIGINT) % 3 + 1)) AS batch_id FROM minute_rows),
minute_log AS (
  SELECT window_start_ms, ad_id, country, device_type,
         'adv-' || ((CAST(split_part(advertiser_id, '-', 2) AS BIGINT) + last - batch_id) % {N_ADVERTISERS}) AS advertiser_id,
         click_count + last - batch_id AS click_count, unique_sessions, batch_id, CAST(0 AS BIGINT) AS emit_seq
  FROM versions
)"""


# ------------------------------------------------- addresses and ranges --

def _dotted(n: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))


def _group(n: Column) -> Column:
    return F.concat(F.lit("2001:db8:"), F.lower(F.hex(n)))


def load_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, raw_ip: an address per event, every third one IPv6, the others all over IPv4."""
    e = F.col("event_id").cast("long")
    v6 = F.concat(_group(e * 40503 % 65536), F.lit("::"), F.lower(F.hex(F.col("user_id").cast("long") % 65536)))
    return (load(spark, sf_dir, "events", ["event_id", "user_id"])
            .select("event_id", F.when(e % 3 == 0, v6).otherwise(_dotted(e * 2654435761 % (1 << 32))).alias("raw_ip")))


def load_nested_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ip_from, ip_to, country: wide ranges of nations, narrower ones of suppliers across and inside them."""
    k, s = F.col("n_nationkey").cast("long"), F.col("s_suppkey").cast("long")
    nations = load(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    suppliers = load(spark, sf_dir, "supplier", ["s_suppkey"])
    first, group = s * 2654435761 % (1 << 32), s * 40503 % 65536

    def rows(df, low, high, country, text, tail=""):
        return df.select(text(low).alias("ip_from") if not tail else F.concat(text(low), F.lit("::")).alias("ip_from"),
                         F.concat(text(high), F.lit(tail)).alias("ip_to"), country.alias("country"))

    six = ":ffff" * 5
    return (rows(nations, k * 10 * (1 << 24), (k + 1) * 10 * (1 << 24) - 1, F.col("n_name"), _dotted)
            .unionByName(rows(nations, k * 2600, k * 2600 + 2599, F.col("n_name"), _group, six))
            .unionByName(rows(suppliers, first, F.least(first + F.expr("shiftleft(1L, cast(8 + s_suppkey % 16 as int))") - 1, F.lit((1 << 32) - 1)),
                              F.concat(F.lit("zone-"), s % 50), _dotted))
            .unionByName(rows(suppliers, group, F.least(group + s % 2000, F.lit(65535)), F.concat(F.lit("six-"), s % 50), _group, six)))


NESTED_RANGES_SQL = """
nested AS (
  SELECT 4 AS family, CAST(n_nationkey AS BIGINT) * 10 * 16777216 AS low, (CAST(n_nationkey AS BIGINT) + 1) * 10 * 16777216 - 1 AS high,
         n_name AS country FROM nation
  UNION ALL SELECT 6, CAST(n_nationkey AS BIGINT) * 2600, CAST(n_nationkey AS BIGINT) * 2600 + 2599, n_name FROM nation
  UNION ALL SELECT 4, f, least(f + (CAST(1 AS BIGINT) << (8 + s % 16)) - 1, 4294967295), 'zone-' || (s % 50)
            FROM (SELECT CAST(s_suppkey AS BIGINT) AS s, CAST(s_suppkey AS BIGINT) * 2654435761 % 4294967296 AS f FROM supplier)
  UNION ALL SELECT 6, g, least(g + s % 2000, 65535), 'six-' || (s % 50)
            FROM (SELECT CAST(s_suppkey AS BIGINT) AS s, CAST(s_suppkey AS BIGINT) * 40503 % 65536 AS g FROM supplier)
),
numbers AS (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 6 ELSE 4 END AS family, CAST(user_id AS BIGINT) % 65536 AS low_group,
         CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS BIGINT) * 40503 % 65536
              ELSE CAST(event_id AS BIGINT) * 2654435761 % 4294967296 END AS n
  FROM events
),
addresses AS (
  SELECT event_id, family, n,
         CASE WHEN family = 6 THEN '2001:db8:' || format('{:x}', n) || '::' || format('{:x}', low_group)
              ELSE (n >> 24) || '.' || ((n >> 16) & 255) || '.' || ((n >> 8) & 255) || '.' || (n & 255) END AS client_ip
  FROM numbers
)"""
