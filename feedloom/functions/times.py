"""Timestamp parsing and formatting, always in UTC."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import as_column

# Calendar date, optionally a time of day, optionally an offset.
_EXTENDED = r"^\d{4}(-\d{2}(-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?)?)?$"
_BASIC_FORMATS = (
    "yyyyMMdd",
    "yyyyMMdd'T'HHmm[XXX][XX][X]",
    "yyyyMMdd'T'HHmmss[XXX][XX][X]",
    "yyyy-MM-dd'T'HH[XXX][XX][X]",
    "yyyy-MM-dd'T'HHmmss[XXX][XX][X]",
)


# Year and week, optionally a day from 1 (Monday) on, then anything a calendar date may be followed by.
_WEEK = r"^(\d{4})(-?)W(\d{2})(?:\2([1-7]))?(T.*)?$"


def _week_time(c: Column) -> Column:
    """The time of a week date; a week that does not exist gives NULL."""
    year = F.regexp_extract(c, _WEEK, 1).try_cast("int")
    week = F.regexp_extract(c, _WEEK, 3).try_cast("int")
    day = F.coalesce(F.regexp_extract(c, _WEEK, 4).try_cast("int"), F.lit(1))
    fourth = F.make_date(year, F.lit(1), F.lit(4))  # always in the first week
    monday = F.date_add(F.date_sub(fourth, F.weekday(fourth)), (week - 1) * 7)
    real = (week > 0) & (F.year(F.date_add(monday, 3)) == year)
    text = F.concat(F.date_format(F.date_add(monday, day - 1), "yyyy-MM-dd"), F.regexp_extract(c, _WEEK, 5))
    return F.when(real, F.try_to_timestamp(text))


def parse_iso8601(col: Column | str) -> Column:
    """ISO-8601 text to a timestamp; no offset means UTC, unreadable text gives NULL."""
    c = F.trim(as_column(col))
    dotted = F.regexp_replace(
        F.regexp_replace(c, ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2"
    )
    usual = F.when(c.rlike(r"T|\s|^\d{4}-\d{2}(-\d{2})?$") & c.rlike(_EXTENDED),
                   F.try_to_timestamp(F.when(c.rlike(r"[T ].*[+-]\d{4}$"), dotted).otherwise(F.regexp_replace(c, ",", "."))))
    year = F.when(c.rlike(r"^\d{4}$"), F.try_to_timestamp(c, F.lit("yyyy")))
    basic = [F.try_to_timestamp(c, F.lit(p)) for p in _BASIC_FORMATS]
    return F.when(c.rlike(_WEEK), _week_time(c)).otherwise(F.coalesce(usual, year, *basic))


def epoch_to_timestamp(col: Column | str) -> Column:
    return F.timestamp_seconds(as_column(col))


def format_iso_z(col: Column | str) -> Column:
    """ISO text with a ``Z``; microseconds appear only when there are any."""
    c = as_column(col)
    has_fraction = F.unix_micros(c) % 1_000_000 != 0
    return F.when(
        has_fraction, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    ).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def utc(value: datetime) -> datetime:
    """The given time in UTC; a naive time is taken as UTC."""
    return value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value.astimezone(timezone.utc)


def days_before(as_of: datetime, days: int) -> datetime:
    return utc(as_of) - timedelta(days=days)


def default_since(as_of: datetime, interval_seconds: int) -> datetime:
    """Where a source without a mark starts: two poll intervals back."""
    return utc(as_of) - timedelta(seconds=2 * interval_seconds)
