"""Randomised differential test: the Column functions against plain-Python
statements of the same (Java) rules, over a few thousand generated strings."""

import hashlib
import random

from pyspark.sql import types as T

from clickwise.functions import (
    device_type_from_ua, extract_client_ip, geo_country_stub, hash_ip, is_blank, java_strip,
    resolve_click_id,
)

# Character.isWhitespace: Unicode space separators except the no-break ones,
# plus \t \n \x0b \f \r and the four information separators.
JAVA_WS = set("\t\n\x0b\f\r\x1c\x1d\x1e\x1f\u0020\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
              "\u2006\u2008\u2009\u200a\u2028\u2029\u205f\u3000")
PIECES = [" ", "\t", "\n", "\u2003", "\u3000", "\u00a0", "\u2007", "\x1f", ",", ".", "1", "10.", "127.", "192.168.", "::1", "a", "Z",
          "iPad", "TABLET", "Kindle", "Mobile", "android", "iPhone", "Windows Phone", "BlackBerry",
          "Mozilla/5.0", "203.0.113.7", "é", "ß"]


def blank(s):
    return s is None or all(c in JAVA_WS for c in s)


def strip(s):
    i, j = 0, len(s)
    while i < j and s[i] in JAVA_WS:
        i += 1
    while j > i and s[j - 1] in JAVA_WS:
        j -= 1
    return s[i:j]


def client_ip(xff, real, remote):
    if not blank(xff):
        return strip(xff.split(",", 1)[0])
    if not blank(real):
        return strip(real)
    return remote


def device(ua):
    if blank(ua):
        return "UNKNOWN"
    u = ua.lower()
    if any(m in u for m in ("ipad", "tablet", "kindle")):
        return "TABLET"
    if any(m in u for m in ("mobile", "android", "iphone", "windows phone", "blackberry")):
        return "MOBILE"
    return "DESKTOP"


def geo(ip):
    if ip is None:
        return None
    return "LOCAL" if ip.startswith(("127.", "10.", "192.168.")) or ip == "::1" else "US"


def hashed(ip):
    return "unknown" if blank(ip) else hashlib.sha256(ip.encode()).hexdigest()


def click_id(cid, ad, pl, sess, ts):
    if not blank(cid):
        return cid
    seed = f"{ad}:{'null' if pl is None else pl}:{'null' if sess is None else sess}:{ts // 5000}"
    h = hashlib.sha256(seed.encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"


def rand_text(rnd):
    if rnd.random() < 0.1:
        return None
    return "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(0, 5)))


def test_functions_against_python(spark):
    rnd = random.Random(11)
    rows = [(rand_text(rnd), rand_text(rnd), rand_text(rnd), rand_text(rnd),
             rnd.randrange(0, 4_000_000_000_000)) for _ in range(3000)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField(n, T.StringType()) for n in "abcd"] +
                                                  [T.StructField("ts", T.LongType())]))
    out = df.select(
        is_blank("a"), java_strip("a"), extract_client_ip("a", "b", "c"), device_type_from_ua("a"),
        geo_country_stub("a"), hash_ip("a"), resolve_click_id("a", "b", "c", "d", "ts"),
    ).collect()
    for (a, b, c, d, ts), got in zip(rows, out):
        want = (blank(a), None if a is None else strip(a), client_ip(a, b, c), device(a), geo(a), hashed(a),
                click_id(a, "null" if b is None else b, c, d, ts))
        assert tuple(got) == want, (a, b, c, d, ts)
