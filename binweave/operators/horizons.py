"""Horizons, splits and folds: labels at any horizon, rolling daily refits of linear models, day-disjoint splits, day backtests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lags import at_offset
from .models import ridge


def check_horizon(minutes: int) -> int:
    """The horizon in bins of ten minutes; an error if it isn't a multiple of ten from 10 to 1440."""
    if minutes % 10 or not 10 <= minutes <= 1440:
        raise ValueError(f"no horizon of {minutes} minutes")
    return minutes // 10


def horizon_rows(bins: DataFrame, minutes: int, per_day: int = 144, key: str = "route") -> DataFrame:
    """Every bin with its label `minutes` ahead, and what persistence, the day before and the week before say of it; all by frames over bin numbers."""
    h = check_horizon(minutes)
    return bins.withColumns({"label": at_offset("y", h, key), "persistence": F.col("y"), "d1": at_offset("y", h - per_day, key), "d7": at_offset("y", h - 7 * per_day, key)}).filter("label is not null")


def known_day(minutes: int = 30, label_s: int = 600, offset_s: int = 28800) -> Column:
    """The first local day at whose start the label of a row is known."""
    return F.floor((F.col("bin") * 600 + minutes * 60 + label_s + offset_s + 86399) / 86400).cast("long")


def rolling_ridge(rows: DataFrame, features: list[str], label: str, key: str, day: str = "local_day", minutes: int = 30, alpha: float = 1.0, least: int = 500) -> DataFrame:
    """Every row with `ridge`, the prediction of a ridge refitted for its day on all rows of its key whose labels were known when the day began.

    One aggregation makes the sums of products of each key and day; fits are running sums of those, solved one small system per key and day.
    A day with fewer than `least` rows before it has no prediction.
    """
    table = ridge_days(rows, features, label, key, day, minutes, alpha, least)
    w = F.col("weights")
    value = sum((F.col(c) * w[i] for i, c in enumerate(features)), w[len(features)])
    return rows.join(table, [key, day], "left").withColumn("ridge", value).drop("weights")


def ridge_days(rows: DataFrame, features: list[str], label: str, key: str, day: str = "local_day", minutes: int = 30, alpha: float = 1.0, least: int = 500) -> DataFrame:
    """(key, day, weights): the coefficients and intercept of each day's ridge, as a table; a series' task sees one row of sums per day."""
    x = [*(F.col(c).cast("double") for c in features), F.lit(1.0)]
    k = len(x)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    ready = rows.filter(F.col(label).isNotNull())
    for c in features:
        ready = ready.filter(F.col(c).isNotNull())
    sums = ready.groupBy(key, known_day(minutes).alias("_d")).agg(F.count("*").alias("_n"), F.array(*(F.sum(x[i] * x[j]) for i, j in pairs)).alias("_p"), F.array(*(F.sum(v * F.col(label)) for v in x)).alias("_q"))
    days = rows.select(key, F.col(day).cast("long").alias("_d")).distinct().withColumn("_test", F.lit(True))
    both = days.join(sums, [key, "_d"], "full")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out, n, a, q = [], 0, np.zeros((k, k)), np.zeros(k)
        for r in pdf.sort_values("_d").itertuples(index=False):
            d, test, own, p, own_q = r[1:]
            if p is not None:
                n += int(own)
                for (i, j), v in zip(pairs, p, strict=True):
                    a[i, j] += v
                    a[j, i] = a[i, j]
                q = q + np.asarray(own_q)
            if test == 1 and n >= least:
                out.append((r[0], d, ridge(n, a, q, alpha).tolist()))
        return pd.DataFrame(out, columns=[key, day, "weights"])

    ordered = both.select(key, "_d", "_test", "_n", "_p", "_q")
    return ordered.groupBy(key).applyInPandas(fit, f"{key} {rows.schema[key].dataType.simpleString()}, {day} long, weights array<double>")


def split_days(rows: DataFrame, day: str = "local_day", cuts: tuple[float, float, float] = (0.6, 0.7, 0.85), parts: tuple[str, ...] = ("fit", "inner", "validation", "test")) -> DataFrame:
    """part: whole days in order go to fit, inner, validation and test by their rank's share of all days."""
    days = rows.select(day).distinct()
    n = F.count("*").over(Window.partitionBy(F.lit(1)))  # one row per day
    share = (F.row_number().over(Window.orderBy(day)) - 1) / n
    part = F.when(share < cuts[0], parts[0]).when(share < cuts[1], parts[1]).when(share < cuts[2], parts[2]).otherwise(parts[3])
    return rows.join(F.broadcast(days.withColumn("part", part)), day)


def boundary_masked(rows: DataFrame, label: str, ahead: int, order: tuple[str, ...] = ("fit", "inner", "validation", "test"), day: str = "local_day", offset_s: int = 28800) -> DataFrame:
    """Labels whose target falls on a day of a later part, or of none, become null."""
    days = rows.select(F.col(day).alias("_d"), F.col("part").alias("_p")).distinct()
    target = F.floor(((F.col("bin") + ahead) * 600 + offset_s) / 86400).cast("long")
    rank = lambda c: F.array_position(F.array(*map(F.lit, order)), F.col(c))
    both = rows.withColumn("_d", target).join(F.broadcast(days), "_d", "left")
    return both.withColumn(label, F.when(F.coalesce(rank("_p") <= rank("part"), F.lit(False)), F.col(label))).drop("_d", "_p")


def chronological_split(rows: DataFrame, order: list[str], share: float, key: str | None = None) -> DataFrame:
    """part: train for the first floor(n * share) rows in order of the distinct times, test for the rest; rows of one time stay together."""
    times = rows.select(*([key] if key else []), *order).distinct()
    w = Window.partitionBy(key if key else F.lit(1))  # distinct times of a series, which its span bounds
    cut = times.withColumn("_r", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w)).withColumn("part", F.when(F.col("_r") <= F.floor(F.col("_n") * share), "train").otherwise("test")).drop("_r", "_n")
    return rows.join(cut, [*([key] if key else []), *order])


def backtest_days(bins: DataFrame, least: float = 0.9, per_day: int = 144, key: str = "route", offset_s: int = 28800) -> DataFrame:
    """(key, local_day) of the days that are covered well enough."""
    day = F.floor((F.col("bin") * (86400 // per_day) + offset_s) / 86400).cast("long")
    return bins.filter("y is not null").groupBy(key, day.alias("local_day")).agg(F.count("*").alias("n")).filter(F.col("n") >= least * per_day)


def day_backtest(rows: DataFrame, methods: list[str], actual: str, key: str, day: str) -> DataFrame:
    """Per key, day and method: n and MAE on the rows that all methods have."""
    common = rows.filter(F.col(actual).isNotNull())
    for m in methods:
        common = common.filter(F.col(m).isNotNull())
    long = common.unpivot([key, day, actual], methods, "method", "_p")
    return long.groupBy(key, day, "method").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("_p") - F.col(actual))).alias("mae"))


def ablation(rows: DataFrame, sets: dict[str, list[str]], label: str, key: str, part: str = "part", alpha: float = 1.0) -> DataFrame:
    """Test error of a ridge on each set of features, fitted on the training part, all on the rows that have every feature."""
    from .models import with_ridge

    every = sorted({c for own in sets.values() for c in own})
    both = rows.filter(F.col(label).isNotNull())
    for c in every:
        both = both.filter(F.col(c).isNotNull())
    train, predicted = both.filter(F.col(part) == "train"), both.filter(F.col(part) == "test")
    for name, own in sets.items():
        predicted = with_ridge(predicted, own, label, key, alpha, train, name)
    return predicted.select(label, *sets).unpivot([label], list(sets), "features", "_p").groupBy("features").agg(F.count("_p").alias("n"), F.avg(F.abs(F.col("_p") - F.col(label))).alias("mae"))
