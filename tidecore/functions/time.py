"""Column helpers for epoch seconds; none of them depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86_400
SECONDS_PER_HOUR = 3_600
DAYS_PER_YEAR = 365


def epoch_date(ts: Column) -> Column:
    """UTC calendar date of epoch seconds."""
    days = F.floor(ts / F.lit(SECONDS_PER_DAY)).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def date_text(date: Column) -> Column:
    return date.cast("string")


def hour_start(ts: Column) -> Column:
    """Epoch seconds of the beginning of the hour."""
    return ts - F.pmod(ts, F.lit(SECONDS_PER_HOUR))


def epoch_seconds(timestamp: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without time zone."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", origin, timestamp.cast("timestamp_ntz"))
