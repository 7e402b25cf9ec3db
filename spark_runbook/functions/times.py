"""Seconds and texts of times, independent of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def secs(t: Column | str) -> Column:
    """Whole seconds since 1970 of a time without zone; null stays null."""
    t = F.col(t) if isinstance(t, str) else t
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t.cast("timestamp_ntz"))


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def time_diff(a: Column, b: Column) -> Column:
    """Seconds from a to b."""
    return secs(b) - secs(a)


def duration_text(seconds: Column, mask: str) -> Column:
    """An interval's seconds by one of the masks DDD, HHH, HH, MMM, MM, SSS, SS, FF: totals for three letters, parts within the next unit for two; FF milliseconds."""
    s = F.floor(seconds)
    parts = {
        "DDD": F.floor(s / 86400), "HHH": F.floor(s / 3600), "HH": F.floor(s / 3600) % 24, "MMM": F.floor(s / 60), "MM": F.floor(s / 60) % 60,
        "SSS": s, "SS": s % 60, "FF": F.floor(seconds * 1000) % 1000,
    }
    if mask not in parts:
        raise ValueError(f"unknown mask {mask!r}")
    width = {"HH": 2, "MM": 2, "SS": 2, "FF": 3}.get(mask, 1)
    n = parts[mask].cast("long").cast("string")
    return F.lpad(n, width, "0") if width > 1 else n


def date_texts(t: Column) -> dict[str, Column]:
    """The three date forms: day/month/year:hour/minute/second, hour:minute:second, yearmonthday."""
    t = t.cast("timestamp_ntz")
    return {"stamp": F.date_format(t, "dd/MM/yyyy:HH/mm/ss"), "clock": F.date_format(t, "HH:mm:ss"), "day": F.date_format(t, "yyyyMMdd")}


def duration_seconds(millis: Column) -> Column:
    """Seconds, cut to milliseconds, of a duration in milliseconds with fractions."""
    return F.floor(millis) / 1000
