"""Device type from the user agent (FN-4) and enum normalisation (PRJ-2)."""

from pyspark.sql import Column, functions as F

from clickwise.functions.text import _c, is_blank
from clickwise.schemas import DEVICE_TYPES, UNKNOWN

# User-agent markers, tested in this order (tablets first).
TABLET_MARKERS = ("ipad", "tablet", "kindle")
MOBILE_MARKERS = ("mobile", "android", "iphone", "windows phone", "blackberry")


def _any_contains(c: Column, markers) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | c.contains(m)
    return out


def device_type_from_ua(user_agent) -> Column:
    ua = _c(user_agent)
    low = F.lower(ua)
    return (F.when(is_blank(ua), F.lit(UNKNOWN))
             .when(_any_contains(low, TABLET_MARKERS), F.lit("TABLET"))
             .when(_any_contains(low, MOBILE_MARKERS), F.lit("MOBILE"))
             .otherwise(F.lit("DESKTOP")))


def normalize_device_type(device_type) -> Column:
    """Known enum values pass, null or anything else becomes UNKNOWN."""
    d = _c(device_type)
    return F.when(d.isin(*DEVICE_TYPES), d).otherwise(F.lit(UNKNOWN))
