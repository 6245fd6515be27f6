"""Two lag families that differ wherever a bin is missing: positional_* by row, timed_* by bin number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bins import ordered


def positional_lags(bins: DataFrame, key: str = "route", lags: tuple[int, ...] = (1, 2, 3, 6)) -> DataFrame:
    w = ordered(key)
    out = bins.withColumns({f"lag_{k}": F.lag("y", k).over(w) for k in lags})
    return out.withColumn("slope", F.lag("y", 1).over(w) - F.lag("y", 4).over(w))


def positional_means(bins: DataFrame, key: str = "route", spans: tuple[int, ...] = (3, 6)) -> DataFrame:
    """Means of the rows before this one, which is left out."""
    return bins.withColumns({f"roll_{k}": F.avg("y").over(ordered(key).rowsBetween(-k, -1)) for k in spans})


def positional_labels(bins: DataFrame, key: str = "route", leads: tuple[int, ...] = (3, 6)) -> DataFrame:
    """The row `k` ahead, and whether it is k bins ahead in time."""
    w = ordered(key)
    return bins.withColumns({f"lead_{k}": F.lead("y", k).over(w) for k in leads} | {f"exact_{k}": F.coalesce((F.lead("bin", k).over(w) - F.col("bin") == k).cast("long"), F.lit(0)) for k in leads})


def at_offset(column: str, k: int, key: str = "route") -> Column:
    """The value k bins later (earlier if negative); null if that bin is missing. One frame, no join; bins must be unique."""
    return F.max(column).over(ordered(key).rangeBetween(k, k))


def timed_features(bins: DataFrame, key: str = "route", steps: int = 6, labels: tuple[int, ...] = (3, 6)) -> DataFrame:
    """Lags by time, means over those that exist, slope, labels and persistence; needs after_gap, which empties the lag features."""
    ok = F.col("after_gap") == 0
    raw = {f"lag_{10 * k}": F.when(ok, at_offset("y", -k, key)) for k in range(1, steps + 1)}
    mean = lambda k: F.avg("y").over(ordered(key).rangeBetween(-k, -1))
    more = {f"roll_mean_{10 * k}": F.when(ok, mean(k)) for k in (3, 6)}
    slope = {"slope_30": F.when(ok, at_offset("y", -1, key) - at_offset("y", -4, key))}
    return bins.withColumns(raw | more | slope | {f"y_{10 * k}": at_offset("y", k, key) for k in labels} | {"y_persistence": F.col("y")})
