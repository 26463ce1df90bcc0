"""Seasons, blocks and clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def season(day: Column) -> Column:
    """The year in which a season that starts in July ends."""
    return F.year(day) + F.when(F.month(day) >= 7, 1).otherwise(0)


def monday(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def local_day(moment: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(moment, zone))


def utc_moment(day: Column, hour: Column, minute: Column, zone: str) -> Column:
    """A wall clock in ``zone`` as a UTC timestamp, daylight saving heeded."""
    wall = F.to_timestamp(F.concat_ws(" ", day.cast("string"), F.format_string("%02d:%02d:00", hour, minute)))
    return F.to_utc_timestamp(wall, zone)


def utc_offset_hours(moment: Column, zone: Column) -> Column:
    return (F.unix_timestamp(F.from_utc_timestamp(moment, zone)) - F.unix_timestamp(moment)) / 3600.0


def clock_seconds(clock: Column) -> Column:
    """M:SS to seconds."""
    parts = F.split(clock, ":")
    return parts[0].cast("int") * 60 + parts[1].cast("int")


def afternoon_clock(raw: Column) -> Column:
    """'07:30 (ET)' to minutes after midnight: hours 1 to 11 are past noon, 12 is noon."""
    hour = F.regexp_extract(raw, r"^(\d{1,2}):(\d{2})", 1).cast("int")
    minute = F.regexp_extract(raw, r"^(\d{1,2}):(\d{2})", 2).cast("int")
    return F.when(hour == 12, hour).otherwise(hour + 12) * 60 + minute
