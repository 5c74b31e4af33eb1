"""Time columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds reach this value only in the year 5138, milliseconds passed it in 1973.
MILLIS_FROM = 100_000_000_000


def epoch_seconds(epoch: Column) -> Column:
    """Seconds since 1970 from a value in seconds or milliseconds."""
    return F.when(epoch >= MILLIS_FROM, F.call_function("div", epoch, F.lit(1000))).otherwise(epoch)


def event_time(epoch: Column) -> Column:
    return F.timestamp_seconds(epoch_seconds(epoch))


def release_year(date: Column) -> Column:
    """Year of a ``yyyy-mm-dd`` text, null where it does not parse."""
    return F.get(F.split(date, "-"), F.lit(0)).try_cast("int")


def clock_epoch(clock: Column) -> Column:
    """Seconds since 1970 of a clock reading, read as UTC whatever the session time zone."""
    days = F.datediff(F.to_date(clock), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(clock) * 3600 + F.minute(clock) * 60 + F.second(clock)


def show_date(moment: Column) -> Column:
    """Date as year/month/day without leading zeros, empty for null, in the session time zone."""
    return F.coalesce(F.date_format(moment, "yyyy/M/d"), F.lit(""))
