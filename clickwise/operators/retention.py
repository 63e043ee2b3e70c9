"""Retention (SNK-7): rows expire two years after their window start."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: retention period of all three tables.
RETENTION_YEARS = 2


def _ts(c: str, is_ms: bool) -> Column:
    return F.timestamp_millis(F.col(c)) if is_ms else F.col(c)


def horizon(now, years: int = RETENTION_YEARS) -> dt.datetime:
    """``now`` minus the period: every row up to it has expired, or is a leap day's."""
    d = dt.datetime.fromisoformat(now) if isinstance(now, str) else now
    try:
        return d.replace(year=d.year - years)
    except ValueError:  # 29 February
        return d.replace(year=d.year - years, day=28)


def retained(df: DataFrame, time_col: str, now, years: int = RETENTION_YEARS, is_ms: bool = False) -> DataFrame:
    """Keep rows with ``time + years > now``; ``now`` is a parameter (testable).  The
    column is compared with a literal too, which reaches the scan and prunes it."""
    cut = horizon(now, years)
    literal = F.lit(int(cut.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)) if is_ms else F.lit(cut)
    return df.filter((F.col(time_col) > literal)
                     & (_ts(time_col, is_ms) + F.expr(f"INTERVAL {int(years)} YEARS") > F.lit(now).cast("timestamp")))


def expired_months(months: list[int], now, years: int = RETENTION_YEARS) -> list[int]:
    """Month partitions (yyyymm) whose every row has expired."""
    cut = horizon(now, years)
    return [m for m in months if m < cut.year * 100 + cut.month]
