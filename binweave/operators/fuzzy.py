"""Fuzzy classification over five inputs, convex stacks of two members, and validity of fuzzy clusterings: all relational.

A row fires only the rules of which every term has a degree above zero, which are few (two
neighbouring terms of an input at most), so rows unfold to their rules and sums do the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .models import levels, memberships, trapezoid, trend_terms

LEVELS = ["light", "moderate", "heavy"]


def time_terms(hour: Column) -> dict[str, Column]:
    """night, morning, midday and evening of a decimal hour; the degrees add up to one."""
    h = F.pmod(hour, F.lit(24.0))
    own = {"morning": trapezoid(h, 4, 6, 9, 11), "midday": trapezoid(h, 9, 11, 14, 16), "evening": trapezoid(h, 14, 16, 20, 23)}
    rest = F.lit(1.0) - own["morning"] - own["midday"] - own["evening"]
    return {"night": F.greatest(F.lit(0.0), F.least(F.lit(1.0), rest)), **own}


def day_terms(nonworkday: Column) -> dict[str, Column]:
    x = nonworkday.cast("double")
    return {"workday": F.lit(1.0) - x, "non-workday": x}


def antecedents(now: Column, trend: Column, hour: Column, nonworkday: Column, yesterday: Column) -> dict[str, dict[str, Column]]:
    """The terms of the five inputs, 3 * 3 * 4 * 2 * 3 = 216 rules in all."""
    return {"now": levels(now), "trend": trend_terms(trend), "time": time_terms(hour), "day": day_terms(nonworkday), "yesterday": levels(yesterday)}


def crisp(x: Column, cuts: tuple[float, float] = (20.0, 35.0)) -> Column:
    """0, 1 or 2 for light, moderate and heavy."""
    return F.when(x < cuts[0], 0).when(x < cuts[1], 1).when(x.isNotNull(), 2)


def fired(rows: DataFrame, terms: dict[str, dict[str, Column]], keep: list[str]) -> DataFrame:
    """keep, rule and strength: the product of its terms' degrees."""
    out = rows.select(*keep, *(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("m")) for k, v in own.items())), lambda t: t["m"] > 0).alias(f"_{name}") for name, own in terms.items()))
    for name in terms:
        out = out.withColumn(f"_{name}", F.explode(f"_{name}"))
    strength = F.lit(1.0)
    for name in terms:
        strength = strength * F.col(f"_{name}.m")
    return out.select(*keep, F.concat_ws("|", *(F.concat_ws("=", F.lit(n), F.col(f"_{n}.k")) for n in terms)).alias("rule"), strength.alias("strength"))


def rule_base(rows: DataFrame, terms: dict[str, dict[str, Column]], label: str, support: float = 2.0) -> DataFrame:
    """rule, class, certainty, support: the class of largest summed compatibility (of equal ones the lowest); its sum less the others', over all.

    Rules of less support, or without certainty, are left out.
    """
    sums = fired(rows.filter(F.col(label).isNotNull()), terms, [label]).groupBy("rule", F.col(label).alias("class")).agg(F.sum("strength").alias("s"))
    per = sums.groupBy("rule").agg(F.sum("s").alias("support"), F.max(F.struct("s", (-F.col("class")).alias("c"))).alias("m"))
    certainty = (2 * F.col("m.s") - F.col("support")) / F.col("support")
    return per.select("rule", (-F.col("m.c")).alias("class"), certainty.alias("certainty"), "support").filter((F.col("certainty") > 0) & (F.col("support") >= support))


def scored_classes(rows: DataFrame, terms: dict[str, dict[str, Column]], rules: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """keys, predicted and score: the class of the largest strength times certainty (of equal ones the lowest); the present level where no rule fires."""
    act = fired(rows, terms, keys).join(F.broadcast(rules.select("rule", "class", "certainty")), "rule")  # 216 rules at most
    best = act.groupBy(*keys).agg(F.max(F.struct((F.col("strength") * F.col("certainty")).alias("w"), (-F.col("class")).alias("c"))).alias("b"))
    return rows.select(*keys, crisp(now).alias("_f")).join(best, keys, "left").select(*keys, F.coalesce(-F.col("b.c"), F.col("_f")).alias("predicted"), F.col("b.w").alias("score"))


def pair_stack(rows: DataFrame, a: str, b: str, label: str, key: str, day: str, back: int = 7, least_days: int = 2, gates: list[str] | None = None) -> DataFrame:
    """Every row with `stack`, a * w + b * (1 - w), where w minimises the absolute error over the `back` days before; exactly.

    The best w is the weighted median of (label - b) / (a - b) with weights |a - b|, cut to 0 .. 1; a half with fewer than least_days days.
    With gates (degrees that add up to one) each has a w of its own, fitted with its degrees as weights, and the forecast is the gated sum.
    A fit holds one series' rows of `back` days.
    """
    own = gates or ["_one"]
    ready = rows.withColumn("_one", F.lit(1.0)).filter(F.col(label).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    gated = F.explode(F.array(*(F.struct(F.lit(g).alias("g"), F.col(g).cast("double").alias("d")) for g in own)))
    near = ready.select(key, F.col(day).alias("_d"), (F.col(a) - F.col(b)).alias("_x"), (F.col(label) - F.col(b)).alias("_y"), gated.alias("_g")).withColumn("_for", F.explode(F.sequence(F.col("_d") + 1, F.col("_d") + back)))
    days = near.groupBy(key, "_for").agg(F.count_distinct("_d").alias("_days"))
    points = near.filter("_x <> 0 and _g.d > 0").select(key, "_for", F.col("_g.g").alias("_gate"), (F.col("_y") / F.col("_x")).alias("_r"), (F.abs("_x") * F.col("_g.d")).alias("_v"))
    part = Window.partitionBy(key, "_for", "_gate")
    run = points.withColumn("_c", F.sum("_v").over(part.orderBy("_r"))).withColumn("_t", F.sum("_v").over(part))
    best = run.filter(F.col("_c") >= F.col("_t") / 2).groupBy(key, "_for", "_gate").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.min("_r"))).alias("_w"))
    wide = best.groupBy(key, "_for").agg(*(F.max(F.when(F.col("_gate") == g, F.col("_w"))).alias(f"_w_{g}") for g in own))
    fits = days.join(wide, [key, "_for"], "left").withColumnRenamed("_for", day)
    w = lambda g: F.when(F.col("_days") >= least_days, F.coalesce(F.col(f"_w_{g}"), F.lit(0.5))).otherwise(0.5)
    value = sum((F.col(g) * (F.col(a) * w(g) + F.col(b) * (1 - w(g))) for g in own), F.lit(0.0))
    return rows.withColumn("_one", F.lit(1.0)).join(fits, [key, day], "left").withColumn("stack", value).drop("_one", "_days", *(f"_w_{g}" for g in own))


def validity(rows: DataFrame, features: list[str], centres: np.ndarray) -> DataFrame:
    """One row: the partition coefficient and entropy of a fuzzy clustering, and its compactness over the least separation of centres."""
    x = [F.col(c) for c in features]
    u = memberships(x, centres)
    dist = [sum(((v - float(c)) * (v - float(c)) for v, c in zip(x, row, strict=True)), F.lit(0.0)) for row in centres]
    apart = min(float(((p - q) ** 2).sum()) for i, p in enumerate(centres) for q in centres[:i])
    square = sum((v * v for v in u[1:]), u[0] * u[0])
    entropy = sum((F.when(v > 0, v * F.log(v)).otherwise(0.0) for v in u), F.lit(0.0))
    tight = sum((v * v * d for v, d in zip(u, dist, strict=True)), F.lit(0.0))
    return rows.agg(F.count("*").alias("n"), F.avg(square).alias("coefficient"), (-F.avg(entropy)).alias("entropy"), (F.sum(tight) / F.count("*") / apart).alias("xie_beni"))


def level_memberships(x: Column, centres: list[float], m: float = 2.0) -> list[Column]:
    """Memberships of a value in sorted one-dimensional centres; beyond the outer ones that one has it all."""
    u = memberships([x], np.array(centres)[:, None], m)
    below, above = x <= centres[0], x >= centres[-1]
    return [F.when(below, float(i == 0)).when(above, float(i == len(u) - 1)).otherwise(v) for i, v in enumerate(u)]


def restarts(rows: DataFrame, features: list[str], k: int, seeds: int = 5, m: float = 2.0, rounds: int = 100, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """Centres of fuzzy c-means on standardised features and their objective: the best of several starts, ordered by the first feature.

    Starts are rows drawn by a hash, each next one the farthest in proportion (of a bounded sample of 64 rows a centre); every round
    sums memberships over all rows, for all starts at once.
    """
    stats = rows.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(features)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features))).first()
    mean, sd = np.array([stats[f"m{i}"] for i in range(len(features))]), np.array([stats[f"s{i}"] or 1.0 for i in range(len(features))])
    z = rows.select(*(((F.col(c) - float(mean[i])) / float(sd[i])).alias(f"z{i}") for i, c in enumerate(features))).na.drop()
    names = z.columns
    z = z.persist()
    sample = np.array([list(r) for r in z.orderBy(F.xxhash64(*names)).limit(64 * k).collect()])
    live: dict[int, np.ndarray] = {}
    for seed in range(seeds if len(sample) else 0):
        rng = np.random.default_rng(seed)
        own = [sample[rng.integers(len(sample))]]
        while len(own) < k:
            d = ((sample[:, None] - np.array(own)[None]) ** 2).sum(axis=2).min(axis=1)
            own.append(sample[rng.choice(len(sample), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(sample))])
        live[seed] = np.array(own)

    def sums_of(starts: dict[int, np.ndarray]):
        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = {s: np.zeros(k * (len(names) + 1) + 1) for s in starts}
            for b in batches:
                x = b[names].to_numpy(float)
                for s, centres in starts.items():
                    d = ((x[:, None] - centres[None]) ** 2).sum(axis=2) + 1e-12
                    u = d ** (-1 / (m - 1))
                    u = (u / u.sum(axis=1, keepdims=True)) ** m
                    total[s] += np.concatenate([u.sum(axis=0), (u.T @ x).ravel(), [(u * d).sum()]])
            yield pd.DataFrame([(s, i, v) for s, t in total.items() for i, v in enumerate(t)], columns=["s", "i", "v"])

        return sums

    best: tuple[float, np.ndarray] = (math.inf, next(iter(live.values()), np.zeros((k, len(names)))))
    for _ in range(rounds):
        if not live:
            break
        got: dict[int, np.ndarray] = {s: np.zeros(k * (len(names) + 1) + 1) for s in live}
        for r in z.mapInPandas(sums_of(dict(live)), "s int, i int, v double").groupBy("s", "i").agg(F.sum("v").alias("v")).collect():
            got[r.s][r.i] = r.v
        for s, t in got.items():
            new = t[k:-1].reshape(k, -1) / t[:k, None]
            if t[-1] < best[0]:
                best = (float(t[-1]), live[s])
            if float(np.abs(new - live[s]).max()) < tolerance:
                del live[s]
            else:
                live[s] = new
    z.unpersist()
    out = best[1] * sd + mean
    return out[np.argsort(out[:, 0])], best[0]
