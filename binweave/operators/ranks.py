"""Rank statistics at any size: exact quantiles, mean ranks and Kendall's tau-b, without a window or a buffer over a whole key.

Values fall into blocks: approximate quantiles of all rows are edges, every edge is a block of
its own and so is every gap between two. A value that a hot share of the rows has is an edge,
so that its block has one value and needs no work; a gap holds about one part in `parts` of
the rows. The edges only decide where work goes: results are exact whatever they are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def edges(rows: DataFrame, columns: list[str], parts: int = PARTS) -> dict[str, list[float]]:
    """About `parts` distinct approximate quantiles of each column, over all keys."""
    q = [i / parts for i in range(1, parts)]
    got = rows.agg(*(F.percentile_approx(F.col(c).cast("double"), q, 100 * parts).alias(c) for c in columns)).first()
    return {c: sorted(set(got[c] or [])) for c in columns}


def block(value: Column, cuts: list[float]) -> Column:
    """2 k for values between edge k - 1 and edge k, 2 k + 1 for those equal to edge k; blocks are ordered as their values."""
    below = sum(((value > F.lit(e)).cast("int") for e in cuts), F.lit(0))
    return 2 * below + F.coalesce(value.isin(cuts), F.lit(False)).cast("int")


def _counted(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of equal keys and values as one row with their number; nulls and NaNs left out."""
    own = rows.select(*keys, *(F.col(v).cast("double").alias(v) for v in values))
    for v in values:
        own = own.filter(F.col(v).isNotNull() & ~F.isnan(v))
    return own.groupBy(*keys, *values).agg(F.count("*").alias("_c"))


def _before(counted: DataFrame, keys: list[str], value: str, cuts: list[float]) -> DataFrame:
    """counted(keys, value, _c) with _b: the rows of the key whose value is smaller. Blocks' totals run within a key, values within a block."""
    cells = counted.withColumn("_block", block(F.col(value), cuts))
    run = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per key and block
    totals = cells.groupBy(*keys, "_block").agg(F.sum("_c").alias("_t")).withColumn("_o", F.coalesce(F.sum("_t").over(run), F.lit(0))).drop("_t")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a._block") == F.col("b._block")]
    both = cells.alias("a").join(totals.alias("b"), same).select("a.*", "b._o")
    within = Window.partitionBy(*keys, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("_b", F.col("_o") + F.coalesce(F.sum("_c").over(within), F.lit(0))).drop("_o")


def mean_ranks(rows: DataFrame, keys: list[str], value: str, parts: int = PARTS) -> DataFrame:
    """(keys, value, rank, n): the mean rank, from 1, of every distinct value of a key, and its rows."""
    counted = _counted(rows, keys, [value])
    return _before(counted, keys, value, edges(rows, [value], parts)[value]).select(*keys, value, (F.col("_b") + (F.col("_c") + 1) / 2).alias("rank"), F.col("_c").alias("n"))


def quantiles(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], parts: int = PARTS) -> DataFrame:
    """Exact quantiles with linear interpolation: keys and one column per wanted name -> (value column, share); null where a key has no value.

    Blocks are counted first; only the blocks that hold one of the two neighbouring order statistics are looked into.
    """
    columns = sorted({c for c, _ in wanted.values()})
    cuts = edges(rows, columns, parts)
    shares = {c: sorted({q for own, q in wanted.values() if own == c}) for c in columns}
    long = rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_v"), block(F.col(c).cast("double"), cuts[c]).alias("_block")) for c in columns))).alias("_x")).select(*keys, "_x.*").filter("_v is not null and not isnan(_v)")
    blocks = long.groupBy(*keys, "_name", "_block").agg(F.count("*").alias("_t"))
    own = Window.partitionBy(*keys, "_name")  # one row per key, name and block
    run = own.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"_o": F.coalesce(F.sum("_t").over(run), F.lit(0)), "_n": F.sum("_t").over(own)})
    ask = F.coalesce(*(F.when(F.col("_name") == c, F.array(*map(F.lit, qs))) for c, qs in shares.items()))
    asked = blocks.withColumn("_q", F.explode(ask)).withColumn("_at", (F.col("_n") - 1) * F.col("_q"))
    low = F.floor("_at")
    asked = asked.withColumn("_k", F.explode(F.array_distinct(F.array(low, F.least(low + 1, F.col("_n") - 1))))).filter((F.col("_k") >= F.col("_o")) & (F.col("_k") < F.col("_o") + F.col("_t")))
    asked = asked.withColumn("_share", F.when(F.col("_k") == low, 1 - (F.col("_at") - low)).otherwise(F.col("_at") - low)).select(*keys, "_name", "_block", "_o", "_q", "_k", "_share")
    looked = asked.select(*keys, "_name", "_block").distinct()
    names = [*keys, "_name", "_block"]
    match = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in names]
    values = long.alias("l").join(looked.alias("r"), match("l", "r"), "left_semi").groupBy(*names, "_v").agg(F.count("*").alias("_c"))
    run = Window.partitionBy(*names).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)  # of one block, about a part of the rows
    values = values.withColumn("_e", F.sum("_c").over(run))
    place = F.col("_k") - F.col("_o")
    got = asked.alias("a").join(values.alias("v"), match("a", "v")).filter((place < F.col("_e")) & (place >= F.col("_e") - F.col("_c"))).select(*(F.col(f"a.{k}") for k in keys), F.col("a._name").alias("_name"), "_q", (F.col("_v") * F.col("_share")).alias("_part"))
    pick = lambda c, q: F.sum(F.when((F.col("_name") == c) & (F.col("_q") == q), F.col("_part")))
    out = got.groupBy(*keys).agg(*(pick(c, q).alias(name) for name, (c, q) in wanted.items()))
    if not keys:
        return out
    every = rows.select(*keys).distinct()
    return every.alias("k").join(out.alias("o"), [F.col(f"k.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys], "left").select("k.*", *(f"o.{name}" for name in wanted))


def concordance(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> int:
    """The sum over pairs of weighted points of sign(dx) sign(dy), by merging sorted runs: n log^2 n, ties count nothing."""

    def rising(x: np.ndarray, y: np.ndarray) -> int:
        order = np.lexsort((-y, x))  # of equal x the larger y come first, and so count nothing
        y, w = y[order], c[order]
        n, total, width = len(y), 0, 1
        while width < n:
            pair = np.arange(n) // (2 * width)
            left = np.arange(n) % (2 * width) < width
            key = pair * span + y
            sums = np.concatenate([[0], np.cumsum(w[left])])
            starts = np.searchsorted(pair[left], pair[~left])
            total += int((w[~left] * (sums[np.searchsorted(key[left], key[~left])] - sums[starts])).sum())
            order = np.argsort(key, kind="stable")
            y, w = y[order], w[order]
            width *= 2
        return total

    _, y = np.unique(y, return_inverse=True)
    c, span = c.astype(np.int64), len(y) + 1
    return rising(x, y) - rising(x, y.max(initial=0) - y)


def kendall(rows: DataFrame, keys: list[str], x: str, y: str, parts: int = PARTS) -> DataFrame:
    """Per key: n, tau (tau-b), z with the variance corrected for ties, and the two-sided p; over all pairs of rows, none of which meet in a join.

    A pair counts in the task of its x block, or of its y block if the x blocks differ, or in the table of block counts if both do.
    """
    counted = _counted(rows, keys, [x, y])
    cuts = edges(rows, [x, y], parts)
    cells = counted.withColumns({"_i": block(F.col(x), cuts[x]), "_j": block(F.col(y), cuts[y])})
    kinds = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), "_s long"])

    def summed(a: str, b: str):
        def score(pdf: pd.DataFrame) -> pd.DataFrame:
            s = concordance(pdf[a].to_numpy(), pdf[b].to_numpy(), pdf["_c"].to_numpy())
            return pd.DataFrame([(*(pdf[k].iloc[0] for k in keys), s)], columns=[*keys, "_s"])

        return score

    of_x = cells.filter("_i % 2 = 0").groupBy(*keys, "_i").applyInPandas(summed(x, y), kinds)
    of_y = cells.filter("_j % 2 = 0").groupBy(*keys, "_j", "_i", y).agg(F.sum("_c").alias("_c")).groupBy(*keys, "_j").applyInPandas(summed("_i", y), kinds)
    of_blocks = cells.groupBy(*keys, "_i", "_j").agg(F.sum("_c").alias("_c")).groupBy(*keys).applyInPandas(summed("_i", "_j"), kinds)
    score = of_x.unionAll(of_y).unionAll(of_blocks).groupBy(*keys).agg(F.sum("_s").alias("_s"))

    def ties(v: str, name: str) -> DataFrame:
        t = F.col("_t").cast("double")
        own = counted.groupBy(*keys, v).agg(F.sum("_c").alias("_t"))
        return own.groupBy(*keys).agg(F.sum("_t").alias(f"_n{name}"), F.sum(t * (t - 1)).alias(f"_a{name}"), F.sum(t * (t - 1) * (t - 2)).alias(f"_b{name}"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"_v{name}"))

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return z.map(lambda v: None if v != v else math.erfc(abs(v) / math.sqrt(2)))

    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys] or F.lit(True)
    both = score.alias("s").join(ties(x, "x").alias("p"), same("s", "p")).join(ties(y, "y").alias("q"), same("s", "q"))
    n, s = F.col("_nx").cast("double"), F.col("_s").cast("double")
    tau = F.try_divide(s, F.sqrt((n * (n - 1) - F.col("_ax")) * (n * (n - 1) - F.col("_ay"))) / 2)
    variance = (n * (n - 1) * (2 * n + 5) - F.col("_vx") - F.col("_vy")) / 18 + F.try_divide(F.col("_ax") * F.col("_ay"), 2 * n * (n - 1)) + F.coalesce(F.try_divide(F.col("_bx") * F.col("_by"), 9 * n * (n - 1) * (n - 2)), F.lit(0.0))
    z = F.try_divide(s, F.sqrt(variance))
    return both.select(*(F.col(f"s.{k}") for k in keys), F.col("_nx").alias("n"), tau.alias("tau"), z.alias("z")).withColumn("p", tail("z"))
