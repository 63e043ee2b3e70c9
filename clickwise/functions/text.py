"""Null-or-blank test and whitespace strip with Java's whitespace definition (FLT-3).

Spark evaluates ``rlike`` / ``regexp_replace`` with java.util.regex, whose
``\\p{javaWhitespace}`` class is exactly ``Character.isWhitespace`` — the
definition behind ``String.isBlank`` and ``String.strip``.
"""

from pyspark.sql import Column, functions as F

_WS = r"\p{javaWhitespace}"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_blank(c) -> Column:
    """True when the value is null, empty or whitespace only (never null)."""
    c = _c(c)
    return c.isNull() | c.rlike(rf"^{_WS}*$")


def java_strip(c) -> Column:
    """Remove leading and trailing whitespace (String.strip)."""
    return F.regexp_replace(_c(c), rf"^{_WS}+|{_WS}+$", "")
