"""Country by address range (JN-1) for ranges that may nest or overlap, IPv4 and IPv6.

Addresses are 32 hex digits (``ip_key``), so both families share one order.  The range
table is cut into disjoint segments, the narrowest range that covers a segment names it
(ties: the smaller country), so a click never meets two rows.  A segment lies in one fine
bucket (IPv4 /16, IPv6 /32), or is parted into two edges in fine buckets and a run of whole
ones between them in coarse buckets (/8, /16).  Both lookups are equi-joins on the bucket
with a range residual; Spark broadcasts the pieces when it measures them small.

Defined results: an address that is null or cannot be read gives null, as does one that no
range covers; a range whose ends cannot be read, belong to different families or stand in
the wrong order takes no part; repeated ranges count once.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from clickwise.functions import ip_key, ipv4_key, ipv4_to_long

# Hex digits of an IPv4 address in a key are the last 8, after this prefix.
V4_PREFIX = "0" * 20 + "ffff"
# Key digits of a fine and of a coarse bucket.
FINE, COARSE = {"v4": 28, "v6": 8}, {"v4": 26, "v6": 4}

PIECES = "bucket string, key_from string, key_to string, country string"


def _family(key: Column) -> Column:
    return F.when(key.startswith(V4_PREFIX), "v4").otherwise("v6")


def _prefix(key: Column, digits: dict[str, int]) -> Column:
    return F.when(_family(key) == "v4", F.substring(key, 1, digits["v4"])).otherwise(F.substring(key, 1, digits["v6"]))


def _group_keys(key_from: Column, key_to: Column) -> Column:
    """The coarse buckets that a range touches: at most 256 (IPv4) or 65,536 (IPv6)."""
    def numbers(at: int, size: int) -> Column:
        return F.sequence(*(F.conv(F.substring(k, at, size), 16, 10).cast("long") for k in (key_from, key_to)))

    v4 = F.transform(numbers(25, 2), lambda n: F.concat(F.lit(V4_PREFIX), F.lpad(F.lower(F.hex(n)), 2, "0")))
    v6 = F.transform(numbers(1, 4), lambda n: F.lpad(F.lower(F.hex(n)), 4, "0"))
    return F.when(_family(key_from) == "v4", v4).otherwise(v6)


def disjoint(ranges: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """(from, to, width, country) -> segments in order; the least (width, country) names each."""
    ranges = sorted(ranges)
    points = sorted({r[0] for r in ranges} | {r[1] + 1 for r in ranges})
    live, i, held = [], 0, None
    for point, after in zip(points, [*points[1:], None]):
        while i < len(ranges) and ranges[i][0] == point:
            heapq.heappush(live, (*ranges[i][2:], ranges[i][1]))
            i += 1
        while live and live[0][2] < point:
            heapq.heappop(live)
        if not live:
            continue
        country = live[0][1]
        if held and held[1] == point - 1 and held[2] == country:
            held = (held[0], after - 1, country)
            continue
        if held:
            yield held
        held = (point, after - 1, country)
    if held:
        yield held


def _pieces(group: tuple[str], ranges: pd.DataFrame) -> pd.DataFrame:
    """One coarse bucket's ranges -> its segments' pieces."""
    coarse, out = group[0], []
    family = "v4" if coarse.startswith(V4_PREFIX) else "v6"
    shift = 4 * (32 - FINE[family])
    first = int(coarse, 16) << 4 * (32 - COARSE[family])
    last = first + (1 << 4 * (32 - COARSE[family])) - 1
    clipped = [(max(int(a, 16), first), min(int(b, 16), last), int(b, 16) - int(a, 16), c)
               for a, b, c in zip(ranges.key_from, ranges.key_to, ranges.country)]

    def piece(a: int, b: int, digits: int, country: str) -> None:
        key_from = f"{a:032x}"
        out.append((key_from[:digits], key_from, f"{b:032x}", country))

    for a, b, country in disjoint(clipped):
        left, right = a >> shift, b >> shift
        if left == right:
            piece(a, b, FINE[family], country)
            continue
        piece(a, (left + 1 << shift) - 1, FINE[family], country)
        if right - left > 1:
            piece(left + 1 << shift, (right << shift) - 1, COARSE[family], country)
        piece(right << shift, b, FINE[family], country)
    return pd.DataFrame(out, columns=["bucket", "key_from", "key_to", "country"])


def range_pieces(ranges: DataFrame) -> DataFrame:
    """Ranges (ip_from, ip_to inclusive: address texts, or IPv4 numbers; country) -> disjoint pieces per bucket."""
    def end(name: str) -> Column:
        return ip_key(name) if dict(ranges.dtypes)[name] == "string" else ipv4_key(F.col(name).cast("long"))

    keyed = (ranges.select(end("ip_from").alias("key_from"), end("ip_to").alias("key_to"), "country")
                   .filter((F.col("key_from") <= F.col("key_to")) & F.col("country").isNotNull())
                   .filter(_family(F.col("key_from")) == _family(F.col("key_to"))).distinct())
    return (keyed.withColumn("coarse", F.explode(_group_keys(F.col("key_from"), F.col("key_to"))))
                 .groupBy("coarse").applyInPandas(_pieces, PIECES))


def range_country(ranges: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """JN-1 resolver: ``raw_ip`` -> ``country`` by the range table, with ``ip_num`` (IPv4 number, else null)."""
    pieces = range_pieces(ranges)

    def step(df: DataFrame) -> DataFrame:
        x = df.withColumn("__key", ip_key("raw_ip"))
        for level, digits in enumerate((FINE, COARSE)):
            names = [f"__{name}_{level}" for name in ("bucket", "from", "to", "country")]
            side = pieces.filter(F.length("bucket").isin(*digits.values())).toDF(*names)
            x = x.join(side, (_prefix(x["__key"], digits) == side[names[0]])
                       & x["__key"].between(side[names[1]], side[names[2]]), "left").drop(*names[:3])
        return (x.withColumn("country", F.coalesce("__country_0", "__country_1"))
                 .withColumn("ip_num", ipv4_to_long("raw_ip")).drop("__key", "__country_0", "__country_1"))
    return step
