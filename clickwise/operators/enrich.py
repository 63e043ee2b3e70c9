"""Request enrichment (PRJ-1/2/6/7, JN-1, JN-2, UDX-3/4/5).

The reference runs a chain of decorators per request: country from the raw
IP, then anonymisation, then dedup/publish.  Here every step is a
``DataFrame -> DataFrame`` transform and the chain is ``df.transform(...)``;
Catalyst fuses the projections into one codegen stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from clickwise.functions import (
    device_type_from_ua, extract_client_ip, geo_country_stub, hash_ip,
    normalize_device_type, redirect_url, resolve_click_id, is_blank,
)

Step = Callable[[DataFrame], DataFrame]

# Defaults of the click event for missing request fields.
DEFAULT_ADVERTISER = "unknown"


def resolve_ids(requests: DataFrame) -> DataFrame:
    """FN-1 at intake: keep a client id, else derive one from the 5 s bucket.

    ``generated_id`` flags derived ids (anonymous clicks of one ad within one
    bucket share an id by design).
    """
    return (requests
            .withColumn("generated_id", is_blank(F.col("click_id")))
            .withColumn("click_id", resolve_click_id("click_id", "ad_id", "placement_id",
                                                     "session_id", "ts_ms")))


def with_client_ip(requests: DataFrame) -> DataFrame:
    """FN-3: ``raw_ip`` from the forwarding headers."""
    return requests.withColumn("raw_ip", extract_client_ip("x_forwarded_for", "x_real_ip", "remote_addr"))


def with_device(requests: DataFrame) -> DataFrame:
    """FN-4: device class from the user agent."""
    return requests.withColumn("device_type", device_type_from_ua("user_agent"))


# ---------------------------------------------------------- country (UDX-3) --

def stub_country(df: DataFrame) -> DataFrame:
    """FN-5 resolver: LOCAL for private/loopback, else US; null IP stays null."""
    return df.withColumn("country", geo_country_stub("raw_ip"))


def geo_ranges_from_nation(nation: DataFrame, octets_per_country: int = 10) -> DataFrame:
    """A country range table derived from ``nation``: nation k owns the IPv4
    first octets [k*n, k*n+n-1].  Columns ip_from, ip_to (inclusive), country."""
    k = F.col("n_nationkey").cast("long")
    span = F.lit(1 << 24).cast("long")
    return nation.select(
        (k * octets_per_country * span).alias("ip_from"),
        ((k + 1) * octets_per_country * span - 1).alias("ip_to"),
        F.col("n_name").alias("country"))


# ------------------------------------------------------------ anonymise ----

def anonymise(df: DataFrame) -> DataFrame:
    """FN-6: hashed IP added; the raw IP is dropped by ``to_click_event``."""
    return df.withColumn("hashed_ip", hash_ip("raw_ip"))


# ------------------------------------------------------ destination (UDX-4) --

def stub_destination(df: DataFrame) -> DataFrame:
    """FN-7 resolver."""
    return df.withColumn("destination_url", redirect_url("ad_id"))


def ads_from_part(part: DataFrame) -> DataFrame:
    """An ad dimension derived from ``part``: ad-<partkey>, its advertiser and URL."""
    k = F.col("p_partkey")
    return part.select(
        F.concat(F.lit("ad-"), k.cast("string")).alias("ad_id"),
        F.concat(F.lit("adv-"), (k % 5).cast("string")).alias("advertiser_id"),
        F.concat(F.lit("https://shop.example/p/"), k.cast("string")).alias("destination_url"))


def ad_dimension(ads: DataFrame) -> Step:
    """JN-2: left join to the ad dimension; missing advertiser -> dimension
    value -> 'unknown'; missing URL -> stub URL.

    An equi-join on ``ad_id``: Catalyst broadcasts the dimension only when its
    estimated size is under the broadcast threshold, else shuffles both sides.
    """
    dim = ads.select("ad_id", F.col("advertiser_id").alias("_dim_adv"),
                     F.col("destination_url").alias("_dim_url"))

    def step(df: DataFrame) -> DataFrame:
        j = df.join(dim, "ad_id", "left")
        return (j.withColumn("advertiser_id", F.coalesce(F.col("advertiser_id"), F.col("_dim_adv"),
                                                         F.lit(DEFAULT_ADVERTISER)))
                 .withColumn("destination_url", F.coalesce(F.col("_dim_url"), redirect_url("ad_id")))
                 .drop("_dim_adv", "_dim_url"))
    return step


# -------------------------------------------------------- click event ------

EVENT_COLUMNS = ["click_id", "ad_id", "advertiser_id", "placement_id", "session_id", "hashed_ip",
                 "user_agent", "country", "device_type", "timestamp_ms"]


def to_click_event(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """PRJ-1/PRJ-2/PRJ-6: event projection with the reference's defaults.

    The raw IP and the forwarding headers are not in the select list, so they
    never leave this stage.
    """
    cols: list[Column] = [
        F.col("click_id"), F.col("ad_id"),
        F.coalesce(F.col("advertiser_id"), F.lit(DEFAULT_ADVERTISER)).alias("advertiser_id"),
        F.col("placement_id"), F.col("session_id"),
        F.coalesce(F.col("hashed_ip"), F.lit("")).alias("hashed_ip"),
        F.coalesce(F.col("user_agent"), F.lit("")).alias("user_agent"),
        F.col("country"),
        normalize_device_type("device_type").alias("device_type"),
        F.col("ts_ms").alias("timestamp_ms"),
    ]
    return df.select(*cols, *keep)


def ingest(requests: DataFrame, country: Step = stub_country, keep: tuple[str, ...] = ()) -> DataFrame:
    """PRJ-7: ids -> client IP -> device -> country (needs the raw IP) ->
    anonymise -> event projection.  Dedup is a separate step (see dedup.py)."""
    return (requests.transform(resolve_ids).transform(with_client_ip).transform(with_device)
                    .transform(country).transform(anonymise)
                    .transform(lambda d: to_click_event(d, keep)))
