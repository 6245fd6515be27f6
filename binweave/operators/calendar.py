"""Calendar columns of a bin in local time, and slice labels derived from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def local_seconds(bin_col: str = "bin", width_s: int = 600, offset_s: int = 28800) -> Column:
    return F.col(bin_col) * width_s + offset_s


def with_calendar(df: DataFrame, width_s: int = 600, offset_s: int = 28800) -> DataFrame:
    """tod_min, sine and cosine, five-minute block, Sunday = 1, weekend, peaks and the local day number."""
    t = local_seconds("bin", width_s, offset_s)
    day = F.floor(t / 86400).cast("long")
    minute = F.floor(F.pmod(t, F.lit(86400)) / 60).cast("long")
    dow = F.pmod(day + 4, F.lit(7)).cast("long") + 1
    hour = F.floor(minute / 60)
    angle = F.lit(2 * math.pi) * minute / 1440
    return df.withColumns({
        "tod_min": minute, "tod_sin": F.sin(angle), "tod_cos": F.cos(angle), "tod_block": F.floor(minute / 5).cast("long"), "dow": dow, "is_weekend": dow.isin(1, 7).cast("long"),
        "is_morning_peak": hour.between(6, 10).cast("long"), "is_evening_peak": hour.between(16, 21).cast("long"), "local_day": day,
    })


def with_slices(df: DataFrame) -> DataFrame:
    """period (morning, evening, other), day_type and light, from the calendar columns."""
    period = F.when(F.col("is_morning_peak") == 1, "morning").when(F.col("is_evening_peak") == 1, "evening").otherwise("other")
    return df.withColumns({"period": period, "day_type": F.when(F.col("is_weekend") == 1, "weekend").otherwise("weekday"), "light": F.when(F.col("tod_min").between(420, 1139), "day").otherwise("night")})


def monday_based(df: DataFrame, holidays: list[int] | None = None) -> DataFrame:
    """Variant with Monday = 0, its sine and cosine, and nonworkday: weekend or a listed local day."""
    dow = F.pmod(F.col("local_day") + 3, F.lit(7)).cast("long")
    angle = F.lit(2 * math.pi) * dow / 7
    off = (dow >= 5) | (F.col("local_day").isin(holidays) if holidays else F.lit(False))
    return df.withColumns({"monday_dow": dow, "dow_sin": F.sin(angle), "dow_cos": F.cos(angle), "nonworkday": off.cast("long")})
