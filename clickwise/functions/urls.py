"""Stub destination URL (FN-7)."""

from pyspark.sql import Column, functions as F

from clickwise.functions.text import _c

# Stub redirect URL parts (no URL encoding of the ad id).
REDIRECT_PREFIX = "https://example.com?ad_id="
REDIRECT_SUFFIX = "&source=clickagg"


def redirect_url(ad_id) -> Column:
    return F.concat(F.lit(REDIRECT_PREFIX), F.coalesce(_c(ad_id), F.lit("null")), F.lit(REDIRECT_SUFFIX))
