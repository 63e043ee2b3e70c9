"""Explicit schemas of the engine's tables (no inference anywhere)."""

from pyspark.sql import types as T

# Device type domain of the click event.
DEVICE_TYPES = ("DESKTOP", "MOBILE", "TABLET", "UNKNOWN")
UNKNOWN = "UNKNOWN"

# Raw click request, one row per intake call (before enrichment).
CLICK_REQUEST = T.StructType([
    T.StructField("ad_id", T.StringType(), False),
    T.StructField("click_id", T.StringType(), True),
    T.StructField("placement_id", T.StringType(), True),
    T.StructField("session_id", T.StringType(), True),
    T.StructField("advertiser_id", T.StringType(), True),
    T.StructField("user_agent", T.StringType(), True),
    T.StructField("x_forwarded_for", T.StringType(), True),
    T.StructField("x_real_ip", T.StringType(), True),
    T.StructField("remote_addr", T.StringType(), True),
    T.StructField("ts_ms", T.LongType(), False),
])

# Click event: the de-duplicated, anonymised stream record.
CLICK_EVENT = T.StructType([
    T.StructField("click_id", T.StringType(), False),
    T.StructField("ad_id", T.StringType(), False),
    T.StructField("advertiser_id", T.StringType(), False),
    T.StructField("placement_id", T.StringType(), True),
    T.StructField("session_id", T.StringType(), True),
    T.StructField("hashed_ip", T.StringType(), False),
    T.StructField("user_agent", T.StringType(), False),
    T.StructField("country", T.StringType(), True),
    T.StructField("device_type", T.StringType(), False),
    T.StructField("timestamp_ms", T.LongType(), False),
])

# Group columns of the minute table.
GROUP_KEYS = ("ad_id", "country", "device_type")
