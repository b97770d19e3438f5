"""Instants, zones and sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/New_York"


def local_time(instant: Column, zone: str = ZONE) -> Column:
    """A UTC instant (zoned, or naive in UTC) as naive local time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), instant.cast("timestamp_ntz"))


def from_local(text: Column, pattern: str = "yyyyMMddHHmmss", zone: str = ZONE) -> Column:
    """Digits of local time as naive UTC; the earlier offset in a repeated hour."""
    return F.to_utc_timestamp(F.try_to_timestamp(text, F.lit(pattern)), zone)


def api_instant(text: Column) -> Column:
    """``2015-02-28T07:05:00.000Z`` as naive UTC; null where it has another form."""
    return F.try_to_timestamp(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{1,3})Z$", 1), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")).cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds crossed from one naive timestamp to another."""
    whole = lambda t: F.date_trunc("second", t).cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", whole(start), whole(end))


def days_between(start: Column, end: Column) -> Column:
    """Midnights crossed."""
    return F.datediff(end.cast("date"), start.cast("date")).cast("long")


def trading_session(local: Column) -> Column:
    """Date and part of the trading day: before 09:30, up to 16:00, after."""
    minute = F.hour(local) * 60 + F.minute(local)
    part = F.when(minute < 570, "pre-open").when(minute < 960, "regular").otherwise("after-close")
    return F.concat(local.cast("date").cast("string"), F.lit(" "), part)
