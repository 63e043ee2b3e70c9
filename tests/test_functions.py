"""Scalar functions against plain-Python statements of the same rules."""

import hashlib

import pytest
from pyspark.sql import types as T

from clickwise.functions import (
    device_type_from_ua, extract_client_ip, geo_country_stub, hash_ip, ipv4_to_long, is_blank,
    java_strip, redirect_url, resolve_click_id, late_text, normalize_device_type,
)


JAVA_WS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f"


def py_blank(s):
    return s is None or all(c in JAVA_WS for c in s)


def py_device(ua):
    if py_blank(ua):
        return "UNKNOWN"
    u = ua.lower()
    if any(m in u for m in ("ipad", "tablet", "kindle")):
        return "TABLET"
    if any(m in u for m in ("mobile", "android", "iphone", "windows phone", "blackberry")):
        return "MOBILE"
    return "DESKTOP"


def one(spark, col, values, dtype=T.StringType()):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("x", dtype, True)]))
    return [r[0] for r in df.select(col).collect()]


BLANKS = [None, "", " ", "\t", " \t\n", "\x0b", "a", " a ", " "]


def test_is_blank_matches_java_whitespace(spark):
    got = one(spark, is_blank("x"), BLANKS)
    # Java's Character.isWhitespace: vertical tab and em space (U+2003) count too
    assert got == [True, True, True, True, True, True, False, False, True]


def test_strip(spark):
    assert one(spark, java_strip("x"), ["  a b \t", "x", ""]) == ["a b", "x", ""]


@pytest.mark.parametrize("ua,expected", [
    (None, "UNKNOWN"), ("", "UNKNOWN"), ("\t ", "UNKNOWN"),
    ("Mozilla/5.0 (iPad; CPU OS 17_0) Mobile/15E148", "TABLET"),     # tablet before mobile
    ("Mozilla/5.0 (Linux; Android 13; KFTRWI) Kindle", "TABLET"),
    ("Mozilla/5.0 (Linux; Android 14) Mobile", "MOBILE"),
    ("Mozilla/5.0 (Windows Phone 10.0)", "MOBILE"), ("BlackBerry9700", "MOBILE"),
    ("Mozilla/5.0 (Windows NT 10.0)", "DESKTOP"), ("curl/8.0", "DESKTOP"),
])
def test_device_type(spark, ua, expected):
    assert one(spark, device_type_from_ua("x"), [ua]) == [expected] == [py_device(ua)]


def test_normalize_device_type(spark):
    assert one(spark, normalize_device_type("x"), ["MOBILE", None, "PHONE"]) == ["MOBILE", "UNKNOWN", "UNKNOWN"]


def test_client_ip(spark):
    rows = [("203.0.113.42, 10.0.0.1", None, "127.0.0.1"), (" 203.0.113.1 ", None, "x"),
            (",1.2", None, "r"), (None, " 1.2.3.4 ", "r"), ("  ", "\t", "9.9.9.9"), (None, None, None),
            (",", None, "r")]
    df = spark.createDataFrame(rows, "xff string, real string, remote string")
    got = [r[0] for r in df.select(extract_client_ip("xff", "real", "remote")).collect()]
    assert got == ["203.0.113.42", "203.0.113.1", "", "1.2.3.4", "9.9.9.9", None, ""]


def test_geo_stub(spark):
    vals = [None, "127.0.0.1", "10.1.2.3", "192.168.1.1", "::1", "172.16.0.1", "", "8.8.8.8"]
    assert one(spark, geo_country_stub("x"), vals) == [None, "LOCAL", "LOCAL", "LOCAL", "LOCAL", "US", "US", "US"]


def test_hash_ip(spark):
    vals = [None, " ", "203.0.113.42"]
    assert one(spark, hash_ip("x"), vals) == ["unknown", "unknown",
                                             hashlib.sha256(b"203.0.113.42").hexdigest()]


def test_ipv4_to_long(spark):
    vals = ["1.2.3.4", "255.255.255.255", "256.1.1.1", "::1", None, "1.2.3"]
    assert one(spark, ipv4_to_long("x"), vals) == [16909060, 4294967295, None, None, None, None]


def test_redirect_and_late_text(spark):
    assert one(spark, redirect_url("x"), ["ad-123"]) == ["https://example.com?ad_id=ad-123&source=clickagg"]
    df = spark.createDataFrame([("c6", "ad-1")], "c string, a string")
    assert df.select(late_text("c", "a")).first()[0] == "LATE:c6 adId=ad-1"


def py_click_id(click_id, ad, placement, session, now_ms):
    if click_id is not None and click_id.strip() != "":
        return click_id
    seed = f"{ad}:{'null' if placement is None else placement}:{'null' if session is None else session}:{now_ms // 5000}"
    h = hashlib.sha256(seed.encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"


def test_resolve_click_id(spark):
    rows = [("explicit-click-uuid", "ad-123", None, "sess-abc", 1_704_067_201_234),
            (None, "ad-456", "placement-1", "sess-xyz", 1_704_067_201_234),
            ("  ", "ad-456", "placement-1", "sess-xyz", 1_704_067_204_999),   # same 5 s bucket
            (None, "ad-456", "placement-1", "sess-xyz", 1_704_067_205_000),   # next bucket
            (None, "ad-789", None, None, 1_704_067_201_234),
            (" keep ", "ad-1", None, None, 0)]
    df = spark.createDataFrame(rows, "click_id string, ad_id string, placement_id string, session_id string, ts long")
    got = [r[0] for r in df.select(resolve_click_id("click_id", "ad_id", "placement_id", "session_id", "ts")).collect()]
    assert got == [py_click_id(*r) for r in rows]
    assert got[1] == got[2] != got[3]
    assert got[5] == " keep "  # kept untrimmed
