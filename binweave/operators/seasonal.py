"""Seasonal lookups and the features of a forecast origin, on dense grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lags import at_offset


def same_time_mean(grid: DataFrame, per_day: int = 144, days: int = 7, key: str = "route", column: str = "y") -> DataFrame:
    """tod: the mean of the observed values at this time of day over the `days` days before."""
    w = Window.partitionBy(key, F.pmod(F.col("bin"), F.lit(per_day))).orderBy("bin").rangeBetween(-days * per_day, -1)
    return grid.withColumn("tod", F.avg(column).over(w))


def origin_features(grid: DataFrame, per_day: int = 144, key: str = "route") -> DataFrame:
    """Deltas over 1, 2, 3 and 6 bins, mean and deviation of the last 6 (all required), and rises a day and a week ago."""
    w = Window.partitionBy(key).orderBy("bin").rangeBetween(-5, 0)
    full = F.count("y").over(w) == 6
    day = {f"d{n}": at_offset("y", -n * per_day, key) for n in (1, 7)}
    return (
        grid.withColumns({f"delta_{k}": F.col("y") - at_offset("y", -k, key) for k in (1, 2, 3, 6)} | {"mean_gap": F.when(full, F.avg("y").over(w) - F.col("y")), "deviation": F.when(full, F.stddev_pop("y").over(w))} | day)
        .withColumns({f"gap_d{n}": F.col(f"d{n}") - F.col("y") for n in (1, 7)} | {f"missing_d{n}": F.col(f"d{n}").isNull().cast("long") for n in (1, 7)})
    )


def blended(a: Column, b: Column, wa: float, wb: float) -> Column:
    """Weighted mean of two values, the weights renormalised over those that exist."""
    own = F.when(a.isNotNull(), wa).otherwise(0.0) + F.when(b.isNotNull(), wb).otherwise(0.0)
    return (F.coalesce(a * wa, F.lit(0.0)) + F.coalesce(b * wb, F.lit(0.0))) / F.nullif(own, F.lit(0.0))
