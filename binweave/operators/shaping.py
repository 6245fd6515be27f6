"""Ordered-series shaping: slew limits, trends, window vectors, carry-forward, midpoints, islands."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bins import ordered


def slew_limited(grid: DataFrame, cap: float, key: str = "route", column: str = "y") -> DataFrame:
    """limited: follows the series by at most `cap` a step, anew after each null.

    Recursive, so no window function: series are dealt out and sorted, and each task walks through its rows with one value in hand.
    """
    kind = grid.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, None
        for b in batches:
            out = []
            for k, x in zip(b[key].tolist(), b["x"].tolist(), strict=True):
                if k != now or x != x:
                    now, last = k, None
                if x == x:
                    last = x if last is None else last + max(-cap, min(cap, x - last))
                out.append(last)
            yield pd.DataFrame({key: b[key], "bin": b["bin"], "limited": pd.Series(out, index=b.index, dtype=float)})

    rows = grid.filter(F.col(key).isNotNull()).select(key, "bin", F.coalesce(F.col(column).cast("double"), F.lit(float("nan"))).alias("x"))
    limited = rows.repartition(key).sortWithinPartitions(key, "bin").mapInPandas(walk, f"{key} {kind}, bin long, limited double")
    return grid.join(limited.withColumn("limited", F.when(~F.isnan("limited"), F.col("limited"))), [key, "bin"], "left")


def trends(grid: DataFrame, span: int = 12, key: str = "route") -> DataFrame:
    w = ordered(key)
    return grid.withColumns({"last_diff": F.col("y") - F.lag("y", 1).over(w), "recent_mean": F.avg("y").over(w.rowsBetween(-span + 1, 0))})


def windows(grid: DataFrame, size: int, key: str = "route") -> DataFrame:
    """x: the array of the last `size` values, where all of them exist."""
    w = ordered(key).rowsBetween(-size + 1, 0)
    return grid.withColumn("_n", F.count("y").over(w)).withColumn("x", F.collect_list("y").over(w)).filter(F.col("_n") == size).drop("_n")


def once(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x worked out once: inside a lambda an expression would be evaluated for every element."""
    return F.element_at(F.transform(F.array(x), body), 1)


def z_scored(x: Column) -> Column:
    """An array less its mean over its population deviation; zeros if it is constant."""
    total = lambda v, f: F.aggregate(v, F.lit(0.0), lambda a, e: a + f(e)) / F.size(v)
    scaled = lambda v, mean, sd: F.transform(v, lambda e: F.when(sd > 0, (e - mean) / sd).otherwise(0.0))
    return once(x, lambda v: once(total(v, lambda e: e), lambda mean: once(F.sqrt(total(v, lambda e: (e - mean) * (e - mean))), lambda sd: scaled(v, mean, sd))))


def wavelet_matrix(size: int, level: int = 2) -> np.ndarray:
    """The linear map of a periodised db2 transform: approximation first, then details from coarse to fine. The k-th filter begins at 2 k - 1, around the end."""
    # the db2 scaling filter, from its closed form
    r = np.sqrt(3)
    h = np.array([1 + r, 3 + r, 3 - r, 1 - r]) / (4 * np.sqrt(2))
    g = h[::-1] * np.array([1, -1, 1, -1])
    rows, basis = [], np.eye(size)
    for _ in range(level):
        n = len(basis)
        if n % 2:
            basis = np.vstack([basis, basis[-1:]])
            n += 1
        at = [(2 * k - 1 + np.arange(4)) % n for k in range(n // 2)]
        rows.insert(0, np.array([g @ basis[i] for i in at]))
        basis = np.array([h @ basis[i] for i in at])
    return np.vstack([basis, *rows])


def wavelet_names(size: int, level: int = 2) -> list[str]:
    """Names of the coefficients in the order of wavelet_matrix."""
    sizes = [size]
    for _ in range(level):
        sizes.append(-(-sizes[-1] // 2))
    return [f"dwt_a_{i}" for i in range(sizes[-1])] + [f"dwt_d{k}_{i}" for k in range(level, 0, -1) for i in range(sizes[k])]


def wavelet_features(grid: DataFrame, size: int = 36, level: int = 2, key: str = "route") -> DataFrame:
    """Every complete window's mean, population deviation and wavelet coefficients of its z-scores: dwt_mean, dwt_std, coefficients."""
    x = windows(grid, size, key)
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / size
    sd = F.sqrt(once(mean, lambda m: F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / size))
    return x.withColumns({"dwt_mean": mean, "dwt_std": sd, "coefficients": mapped(z_scored(F.col("x")), wavelet_matrix(size, level))})


def mapped(x: Column, matrix: np.ndarray) -> Column:
    """matrix @ x as a column expression."""
    rows = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in matrix))
    return once(x, lambda own: F.transform(rows, lambda row: F.aggregate(F.zip_with(row, own, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)))


def supervised(grid: DataFrame, size: int, ahead: int, lags: int, key: str = "route") -> DataFrame:
    """Rows whose last `size` values and the label `ahead` bins later exist, with lag_1 (the origin) to lag_<lags>."""
    w = ordered(key)
    out = grid.withColumns({"_n": F.count("y").over(w.rowsBetween(-size + 1, 0)), "label": F.lead("y", ahead).over(w)} | {f"lag_{k}": F.lag("y", k - 1).over(w) for k in range(1, lags + 1)})
    return out.filter((F.col("_n") == size) & F.col("label").isNotNull()).drop("_n")


def tensors(grid: DataFrame, size: int, channels: list[str], key: str = "route") -> DataFrame:
    """tensor: size x channels, nulls in a channel replaced by y."""
    w = ordered(key).rowsBetween(-size + 1, 0)
    out = grid.withColumn("_n", F.count("y").over(w)).withColumn("tensor", F.collect_list(F.array(*(F.coalesce(c, "y") for c in channels))).over(w))
    return out.filter(F.col("_n") == size).drop("_n")


def carried_forward(rows: DataFrame, every_s: int, step_s: int = 600, t: str = "t") -> DataFrame:
    """Each OK row and its copies at every step until the next fetch is due, which say where they come from."""
    copies = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(every_s // step_s - 1))))
    return copies.withColumns({t: F.col(t) + F.col("k") * step_s, "carried": (F.col("k") > 0).cast("long")}).drop("k")


def midpoints(points: DataFrame, key: str, t: str = "t", y: str = "y", step_s: int = 300, slack_s: int = 60, most_s: int = 3600) -> DataFrame:
    """The points and interpolated ones every step in gaps of at least two steps that are within the slack of a multiple."""
    w = Window.partitionBy(key).orderBy(t)
    gap = F.col("_t") - F.col(t)
    steps = F.round(gap / step_s).cast("int")
    nexts = points.select(key, t, y, F.lead(t).over(w).alias("_t"), F.lead(y).over(w).alias("_y"))
    ok = (steps >= 2) & (F.abs(gap - steps * step_s) <= slack_s) & (gap <= most_s)
    new = nexts.filter(ok).withColumn("_k", F.explode(F.sequence(F.lit(1), steps - 1))).select(key, (F.col(t) + F.col("_k") * step_s).cast("long").alias(t), (F.col(y) + (F.col("_y") - F.col(y)) * (F.col("_k") * step_s) / gap).alias(y), F.lit(1).cast("long").alias("interpolated"))
    return points.select(key, t, y, F.lit(0).cast("long").alias("interpolated")).unionAll(new)


def trend_arrow(points: DataFrame, key: str, t: str = "t", y: str = "y", recent_s: int = 1800, prior_s: int = 3600, share: float = 0.1, least: int = 3) -> DataFrame:
    """Per key: up, down or flat, the mean of the newest stretch against the one before; null with too few points."""
    newest = points.groupBy(key).agg(F.max(t).alias("_end"))
    age = F.col("_end") - F.col(t)
    a, b = F.when(age < recent_s, F.col(y)), F.when((age >= recent_s) & (age < recent_s + prior_s), F.col(y))
    m = points.join(newest, key).groupBy(key).agg(F.avg(a).alias("recent"), F.avg(b).alias("prior"), F.count(a).alias("_a"), F.count(b).alias("_b"))
    r = F.col("recent") / F.col("prior")
    arrow = F.when((F.col("_a") >= least) & (F.col("_b") >= least), F.when(r > 1 + share, "up").when(r < 1 - share, "down").otherwise("flat"))
    return m.select(key, arrow.alias("arrow"))


def islands(rows: DataFrame, key: str, at: str, member: Column) -> DataFrame:
    """Runs of consecutive positions that are members: (key, first, last, n)."""
    own = rows.filter(member).withColumn("_i", F.col(at) - F.row_number().over(Window.partitionBy(key).orderBy(at)))
    return own.groupBy(key, "_i").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("_i")


def flagged_runs(days: DataFrame, key: str, at: str, member: Column, within: int = 21) -> DataFrame:
    """Every day (key, at) with the run of flagged days it lies in (first, last), or else the next flagged day of the key within so many days (next, in_days); nulls where there is none.

    days: one row per key and day. A run ends where a day isn't flagged or isn't there.
    """
    w = Window.partitionBy(key).orderBy(at)
    flagged = days.select(key, at, F.coalesce(member, F.lit(False)).alias("_on")).withColumn("_new", (F.col("_on") & ~F.coalesce((F.lag(at).over(w) == F.col(at) - 1) & F.lag("_on").over(w), F.lit(False))).cast("int"))
    runs = flagged.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))  # days of a calendar
    spans = runs.filter("_on").groupBy(key, "_run").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    ahead = runs.withColumn("next", F.min(F.when(F.col("_on"), F.col(at))).over(w.rangeBetween(1, within)))
    both = ahead.alias("a").join(spans.alias("s"), F.col(f"a.{key}").eqNullSafe(F.col(f"s.{key}")) & (F.col("a._run") == F.col("s._run")) & F.col("a._on"), "left")
    return both.select(f"a.{key}", f"a.{at}", "first", "last", F.when(~F.col("_on"), F.col("next")).alias("next"), F.when(~F.col("_on"), F.col("next") - F.col(at)).alias("in_days"))


def best_window(slots: DataFrame, key: str, at: str = "slot", y: str = "y", least: int = 2) -> DataFrame:
    """Per key the first run of at least `least` slots in the fastest quartile; else the slots of lowest mean."""
    q = slots.groupBy(key).agg(F.percentile(y, 0.25).alias("_q"))
    fast = islands(slots.join(q, key), key, at, F.col(y) <= F.col("_q")).filter(F.col("n") >= least).groupBy(key).agg(F.min(F.struct("first", "last")).alias("f"))
    w = Window.partitionBy(key).orderBy(at)
    means = slots.withColumns({"_m": F.avg(y).over(w.rowsBetween(0, least - 1)), "_c": F.count(y).over(w.rowsBetween(0, least - 1)), "_e": F.max(at).over(w.rowsBetween(0, least - 1))}).filter(F.col("_c") == least)
    low = means.groupBy(key).agg(F.min(F.struct("_m", F.col(at).alias("first"), F.col("_e").alias("last"))).alias("l"))
    both = slots.select(key).distinct().join(fast, key, "left").join(low, key, "left")
    return both.select(key, F.coalesce("f.first", "l.first").alias("first"), F.coalesce("f.last", "l.last").alias("last"), F.when(F.col("f").isNotNull(), "quartile").otherwise("lowest_mean").alias("rule"))


def around_minimum(slots: DataFrame, key: str, at: str = "slot", y: str = "y", within: float = 2.0) -> DataFrame:
    """The run around each key's smallest value whose values stay within a bound of it, and the worst slot."""
    best = slots.groupBy(key).agg(F.min(F.struct(y, at)).alias("_b"), F.max_by(at, F.struct(y, -F.col(at))).alias("worst"))
    runs = islands(slots.join(best, key), key, at, F.col(y) <= F.col(f"_b.{y}") + within).join(best, key)
    return runs.filter(F.col(f"_b.{at}").between(F.col("first"), F.col("last"))).select(key, "first", "last", F.col(f"_b.{at}").alias("best"), "worst")
