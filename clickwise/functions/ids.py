"""Click id resolution (FN-1) and the 5-second bucket (FN-2)."""

from pyspark.sql import Column, functions as F

from clickwise.functions.text import _c, is_blank

# Fixed value: width of the id bucket in milliseconds.
ID_BUCKET_MS = 5000


def time_bucket_5s(ts_ms) -> Column:
    """Epoch milliseconds integer-divided by 5000."""
    return F.floor(_c(ts_ms) / F.lit(ID_BUCKET_MS)).cast("long")


def uuid_format(hex_digest) -> Column:
    """First 32 hex characters laid out as 8-4-4-4-12."""
    h = _c(hex_digest)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def _java_text(c) -> Column:
    # String concatenation in Java renders a null reference as the text "null".
    return F.coalesce(_c(c), F.lit("null"))


def resolve_click_id(click_id, ad_id, placement_id, session_id, now_ms) -> Column:
    """Client id when non-blank (kept untrimmed), else a deterministic id.

    The generated id is SHA-256 of ``ad:placement:session:bucket`` formatted as
    a UUID, so rapid re-clicks of one session on one ad share an id.
    """
    seed = F.concat_ws(":", _java_text(ad_id), _java_text(placement_id), _java_text(session_id),
                       time_bucket_5s(now_ms).cast("string"))
    return F.when(is_blank(click_id), uuid_format(F.sha2(seed, 256))).otherwise(_c(click_id))
