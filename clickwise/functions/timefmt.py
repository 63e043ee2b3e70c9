"""Date/time helpers (FN-8..FN-11) and the late-record text (PRJ-5).

All assume ``spark.sql.session.timeZone=UTC`` (set by clickwise.session).
"""

from pyspark.sql import Column, functions as F

from clickwise.functions.text import _c


def event_time(timestamp_ms) -> Column:
    """Epoch milliseconds to TIMESTAMP (the watermark column)."""
    return F.timestamp_millis(_c(timestamp_ms))


def to_start_of_hour(ts) -> Column:
    return F.date_trunc("hour", _c(ts))


def to_start_of_day(ts) -> Column:
    return F.date_trunc("day", _c(ts))


def to_yyyymm(ts) -> Column:
    """Month partition value, e.g. 202401 (int)."""
    return F.date_format(_c(ts), "yyyyMM").cast("int")


def late_text(click_id, ad_id) -> Column:
    """``LATE:<click id> adId=<ad id>``; a null renders as 'null' like Java concat."""
    return F.concat(F.lit("LATE:"), F.coalesce(_c(click_id), F.lit("null")), F.lit(" adId="),
                    F.coalesce(_c(ad_id), F.lit("null")))
