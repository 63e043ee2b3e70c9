"""SQL fragments of the DuckDB oracles (the same rules as the Column
functions, written as SQL so the oracle is an independent statement)."""

from __future__ import annotations

from clickwise.sources.derived import ARRIVAL_SQL_COLUMNS, CLICKS_SQL, REQUESTS_SQL, version_log_sql

# Fixed values, stated here again and not taken from the code under test: device
# markers, local addresses, stub URL parts.
TABLET_MARKERS = ["ipad", "tablet", "kindle"]
MOBILE_MARKERS = ["mobile", "android", "iphone", "windows phone", "blackberry"]
LOCAL_PREFIXES = ("127.", "10.", "192.168.")
LOCAL_EXACT = ("::1",)
REDIRECT_PREFIX, REDIRECT_SUFFIX = "https://example.com?ad_id=", "&source=clickagg"


def blank(x: str) -> str:
    return rf"({x} IS NULL OR regexp_matches({x}, '^\s*$'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def uuid_of(h: str) -> str:
    return (f"substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || "
            f"substr({h},17,4) || '-' || substr({h},21,12)")


def device(ua: str) -> str:
    tab = " OR ".join(f"contains(lower({ua}), '{m}')" for m in TABLET_MARKERS)
    mob = " OR ".join(f"contains(lower({ua}), '{m}')" for m in MOBILE_MARKERS)
    return (f"CASE WHEN {blank(ua)} THEN 'UNKNOWN' WHEN {tab} THEN 'TABLET' "
            f"WHEN {mob} THEN 'MOBILE' ELSE 'DESKTOP' END")


def geo_stub(ip: str) -> str:
    local = " OR ".join([f"starts_with({ip}, '{p}')" for p in LOCAL_PREFIXES] +
                        [f"{ip} = '{e}'" for e in LOCAL_EXACT])
    return f"CASE WHEN {ip} IS NULL THEN NULL WHEN {local} THEN 'LOCAL' ELSE 'US' END"


def redirect(ad: str) -> str:
    return f"'{REDIRECT_PREFIX}' || coalesce({ad}, 'null') || '{REDIRECT_SUFFIX}'"


def client_ip() -> str:
    first_hop = "split_part(x_forwarded_for, ',', 1)"
    return (f"CASE WHEN NOT {blank('x_forwarded_for')} THEN {strip(first_hop)} "
            f"WHEN NOT {blank('x_real_ip')} THEN {strip('x_real_ip')} ELSE remote_addr END")


def ipv4_num(ip: str) -> str:
    parts = [f"CAST(split_part({ip}, '.', {i}) AS BIGINT)" for i in range(1, 5)]
    ok = rf"regexp_matches({ip}, '^(\d{{1,3}})\.(\d{{1,3}})\.(\d{{1,3}})\.(\d{{1,3}})$')"
    return (f"CASE WHEN {ok} AND {' AND '.join(p + ' <= 255' for p in parts)} THEN "
            f"(({parts[0]} * 256 + {parts[1]}) * 256 + {parts[2]}) * 256 + {parts[3]} END")


CLICK_SEED = ("coalesce(ad_id, 'null') || ':' || coalesce(placement_id, 'null') || ':' || "
              "coalesce(session_id, 'null') || ':' || CAST(ts_ms // 5000 AS VARCHAR)")

INGEST_SQL = REQUESTS_SQL + f""",
req1 AS (
  SELECT *, {blank('click_id')} AS generated_id,
         sha256({CLICK_SEED}) AS seed_hash,
         {client_ip()} AS raw_ip,
         {device('user_agent')} AS device_type
  FROM requests
),
req2 AS (
  SELECT *, CASE WHEN generated_id THEN {uuid_of('seed_hash')} ELSE click_id END AS click_id_res,
         {geo_stub('raw_ip')} AS country,
         CASE WHEN {blank('raw_ip')} THEN 'unknown' ELSE sha256(raw_ip) END AS hashed_ip
  FROM req1
),
ingested AS (
  SELECT click_id_res AS click_id, ad_id, coalesce(advertiser_id, 'unknown') AS advertiser_id,
         placement_id, session_id, coalesce(hashed_ip, '') AS hashed_ip,
         coalesce(user_agent, '') AS user_agent, country,
         CASE WHEN device_type IN ('DESKTOP', 'MOBILE', 'TABLET', 'UNKNOWN') THEN device_type
              ELSE 'UNKNOWN' END AS device_type,
         ts_ms AS timestamp_ms, event_id
  FROM req2
)"""

ARRIVALS_SQL = CLICKS_SQL + f""",
arrivals AS (
  SELECT * REPLACE (coalesce(country, 'UNKNOWN') AS country, coalesce(device_type, 'UNKNOWN') AS device_type),
         {ARRIVAL_SQL_COLUMNS}
  FROM clicks
)"""


def minute_agg_body(src: str = "clicks", width_ms: int = 60000) -> str:
    return f"""
SELECT (timestamp_ms // {width_ms}) * {width_ms} AS window_start_ms,
       (timestamp_ms // {width_ms}) * {width_ms} + {width_ms} AS window_end_ms,
       ad_id,
       first(advertiser_id ORDER BY timestamp_ms, click_id) AS advertiser_id,
       coalesce(country, 'UNKNOWN') AS country,
       coalesce(device_type, 'UNKNOWN') AS device_type,
       count(DISTINCT click_id) AS click_count,
       count(DISTINCT session_id) AS unique_sessions
FROM {src}
GROUP BY 1, 2, 3, 5, 6"""


def version_log() -> str:
    """CTE ``minute_log`` over ``clicks``: the stored versions of the minute rows."""
    return version_log_sql(minute_agg_body("clicks"))
