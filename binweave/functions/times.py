"""Time expressions: local days of a fixed offset, complete bins, and ISO text with an offset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_day(seconds: Column, offset_s: int = 28800) -> Column:
    """The number of the local day since 1970."""
    return F.floor((seconds + offset_s) / 86400).cast("long")


def local_day_start(day: Column, offset_s: int = 28800) -> Column:
    """Epoch seconds at which a local day begins."""
    return (day * 86400 - offset_s).cast("long")


def last_complete_bin(seconds: Column, width_s: int = 600) -> Column:
    """Start of the newest bin that has ended."""
    return (F.floor(seconds / width_s) * width_s - width_s).cast("long")


def utc_iso(text: Column) -> Column:
    """ISO text with an offset as UTC text; null without an offset, or if it is no time."""
    t = F.try_to_timestamp(F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text))
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
