"""Date arithmetic that doesn't depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def ymd_to_date(ymd: Column) -> Column:
    """YYYYMMDD as a number -> DATE; null for days that don't exist."""
    s = F.lpad(ymd.cast("string"), 8, "0")
    text = F.concat_ws("-", s.substr(1, 4), s.substr(5, 2), s.substr(7, 2))
    ok = ymd.between(1_01_01, 9999_12_31)
    return F.when(ok, text.try_cast("date"))


def day_number(date: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(date)


def date_of(day: Column) -> Column:
    return F.date_from_unix_date(day.cast("int"))


def ymd_of(day: Column) -> Column:
    """Day number -> YYYYMMDD as bigint."""
    d = date_of(day)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("bigint")


def arrival_seconds(stamp: Column) -> Column:
    """YYYYMMDDHHMMSS or Unix seconds -> Unix seconds (UTC); null for impossible stamps."""
    digits = stamp.cast("string")
    long_form = stamp.between(10**13, 10**14 - 1)
    day = F.unix_date(ymd_to_date(F.floor(stamp / 1_000_000).cast("bigint")))
    h, m, s = (digits.substr(i, 2).try_cast("int") for i in (9, 11, 13))
    parsed = F.when((h < 24) & (m < 60) & (s < 60), day.cast("bigint") * DAY + h * 3600 + m * 60 + s)
    return F.when(long_form, parsed).when(stamp.between(0, 10**11 - 1), stamp.cast("bigint"))


def utc_day(seconds: Column) -> Column:
    """Unix seconds -> day number of the UTC day."""
    return F.floor(seconds / DAY).cast("bigint")
