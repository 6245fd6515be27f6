"""Forecasters, folds and combiners, as aggregates where the mathematics allow.

Linear models are fitted from sums of products: one aggregation with map-side sums per
fit, whatever the rows; the driver solves a system as large as the feature list.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import quantiles


def moments(rows: DataFrame, features: list[Column], label: str, keys: list[str]) -> DataFrame:
    """(keys, n, p, q): rows, the upper half of the sums of feature products (with a constant last) and their products with the label; one aggregation with map-side sums."""
    x = [*(v.cast("double") for v in features), F.lit(1.0)]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    ready = rows.filter(F.col(label).isNotNull())
    for v in features:
        ready = ready.filter(v.isNotNull())
    return ready.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*(F.sum(x[i] * x[j]) for i, j in pairs)).alias("p"), F.array(*(F.sum(v * F.col(label)) for v in x)).alias("q"))


def square(p: np.ndarray, k: int) -> np.ndarray:
    """The symmetric matrix of which p is the upper half, row by row."""
    a = np.zeros((k, k))
    a[np.triu_indices(k)] = p
    return a + np.triu(a, 1).T


def ridge(n: int, a: np.ndarray, q: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients and intercept of a ridge over standardised features, the intercept unpenalised."""
    mean = a[:-1, -1] / n
    sd = np.sqrt(np.maximum(np.diag(a)[:-1] / n - mean**2, 0))
    sd[sd == 0] = 1
    centred = (a[:-1, :-1] - n * np.outer(mean, mean)) / np.outer(sd, sd)
    y = q[-1] / n
    w = np.linalg.solve(centred + alpha * np.eye(len(mean)), (q[:-1] - mean * q[-1]) / sd) / sd
    return np.append(w, y - w @ mean)


def ridge_table(rows: DataFrame, features: list[Column], label: str, key: str, alpha: float = 1.0, least: int = 1) -> DataFrame:
    """(key, weights): coefficients and intercept of one ridge per key, as a table; a key with fewer than `least` rows has its mean alone."""
    k = len(features) + 1

    @F.pandas_udf("array<double>")
    def solve(n: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
        mean = lambda m, v: np.append(np.zeros(k - 1), v[-1] / m)
        return pd.Series([(ridge(m, square(a, k), np.asarray(v), alpha) if m >= least else mean(m, v)).tolist() for m, a, v in zip(n, p, q, strict=True)])

    return moments(rows, features, label, [key]).select(key, solve("n", "p", "q").alias("weights"))


def weighed(rows: DataFrame, table: DataFrame, features: list[Column], keys: list[str], out: str) -> DataFrame:
    """rows with `out`, the linear model of their keys' weights; null without one."""
    w = F.col("_w")
    value = sum((v * w[i] for i, v in enumerate(features)), w[len(features)])
    named = table.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("weights").alias("_w"))
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    return rows.join(named, on, "left").withColumn(out, value).drop("_w", *(f"_k{i}" for i in range(len(keys))))


def imputed(rows: DataFrame, columns: list[str], train: DataFrame | None = None) -> DataFrame:
    """Nulls replaced by the column's median (of the training rows, if given), with missing_<column> flags."""
    medians = quantiles(rows if train is None else train, [], {c: (c, 0.5) for c in columns}).first()
    return rows.withColumns({f"missing_{c}": F.col(c).isNull().cast("double") for c in columns} | {c: F.coalesce(F.col(c), F.lit(medians[c])) for c in columns})


def mean_imputed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls replaced by the column's mean; 0 where it has no value at all."""
    means = rows.agg(*(F.avg(c).alias(c) for c in columns)).first()
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(means[c] if means[c] is not None else 0.0)) for c in columns})


def with_ridge(rows: DataFrame, features: list[str], label: str, key: str, alpha: float = 1.0, train: DataFrame | None = None, out: str = "ridge") -> DataFrame:
    """rows with the prediction of one ridge per key, fitted on the training rows (all, if none are given)."""
    x = [F.col(c) for c in features]
    return weighed(rows, ridge_table(rows if train is None else train, x, label, key, alpha), x, [key], out)


def fourier(minute: Column, weekend: Column, order: int) -> list[Column]:
    """weekend, and sines and cosines of the time of day with their products with it; the time is a bin's middle."""
    angle = (minute + 5) * (2 * math.pi / 1440)
    waves = [f(angle * k) for k in range(1, order + 1) for f in (F.sin, F.cos)]
    return [weekend.cast("double"), *waves, *(w * weekend for w in waves)]


def with_fourier(rows: DataFrame, label: str, key: str, order: int = 4, alpha: float = 1.0, least: int = 10, train: DataFrame | None = None, out: str = "profile") -> DataFrame:
    """rows with a daily profile per key; the mean where a key has under `least` training rows."""
    x = fourier(F.col("tod_min"), F.col("is_weekend"), order)
    return weighed(rows, ridge_table(rows if train is None else train, x, label, key, alpha, least), x, [key], out)


def profile_errors(rows: DataFrame, label: str, key: str, orders: tuple[int, ...], alpha: float = 1.0) -> DataFrame:
    """(harmonics, mae, n): each fold's error under profiles of the other folds.

    One aggregation serves all orders and folds: lower orders use a part of the largest
    one's sums, and leaving a fold out is a subtraction. A key's task sees a row per fold.
    """
    most = max(orders)
    x = fourier(F.col("tod_min"), F.col("is_weekend"), most)
    k = len(x) + 1
    own = {o: [0, *range(1, 1 + 2 * o), *range(1 + 2 * most, 1 + 2 * most + 2 * o), k - 1] for o in orders}
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, "fold")}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        n, p, q = pdf["n"].to_numpy(float), np.stack(pdf["p"].to_numpy()), np.stack(pdf["q"].to_numpy())
        out = []
        for i in range(len(pdf)):
            rest = n.sum() - n[i]
            for o in orders if rest else ():
                w, a, v = np.zeros(k), square(p.sum(axis=0) - p[i], k), q.sum(axis=0) - q[i]
                w[own[o]] = ridge(int(rest), a[np.ix_(own[o], own[o])], v[own[o]], alpha)
                out.append((pdf[key].iloc[i], pdf["fold"].iloc[i], o, w.tolist()))
        return pd.DataFrame(out, columns=[key, "fold", "harmonics", "weights"])

    table = moments(rows, x, label, [key, "fold"]).groupBy(key).applyInPandas(fit, f"{key} {kinds[key]}, fold {kinds['fold']}, harmonics int, weights array<double>")
    long = rows.join(table, [key, "fold"])
    w = F.col("weights")
    e = F.abs(sum((v * w[i] for i, v in enumerate(x)), w[k - 1]) - F.col(label))
    return long.select("harmonics", e.alias("e")).filter("e is not null").groupBy("harmonics").agg(F.avg("e").alias("mae"), F.count("*").alias("n"))


def hour_profile(train: DataFrame, rows: DataFrame, key: str, label: str) -> DataFrame:
    """rows with the training mean of their hour and day type, else of their key."""
    hour = F.floor(F.col("tod_min") / 60)
    fine = train.groupBy(key, hour.alias("_h"), "is_weekend").agg(F.avg(label).alias("_f"))
    coarse = train.groupBy(key).agg(F.avg(label).alias("_c"))
    return rows.withColumn("_h", hour).join(F.broadcast(fine), [key, "_h", "is_weekend"], "left").join(F.broadcast(coarse), key, "left").withColumn("profile", F.coalesce("_f", "_c")).drop("_h", "_f", "_c")


def fold_days(rows: DataFrame, first: int, days: int) -> DataFrame:
    """Rolling-origin folds: for each test day, its rows (part test) and all rows whose label was known before it (part train).

    Exploding rows to folds multiplies them by the number of folds; models made of sums don't need it, see fold_means.
    """
    fold = rows.withColumn("fold", F.explode(F.sequence(F.lit(first), F.lit(first + days - 1))))
    known = F.floor((F.col("bin") * 600 + 2400 + 28800 - 1) / 86400) < F.col("fold")
    return fold.withColumn("part", F.when(F.col("local_day") == F.col("fold"), "test").when(known, "train")).filter("part is not null")


def fold_means(rows: DataFrame, key: str, label: str, least: int = 1) -> DataFrame:
    """Every row with the mean label of its key over all days whose labels were known before the row's day: daily sums and a running window."""
    known = F.floor((F.col("bin") * 600 + 2400 + 28800 - 1) / 86400)
    w = Window.partitionBy(key).orderBy("local_day").rangeBetween(Window.unboundedPreceding, -1)
    sums = rows.filter(F.col(label).isNotNull()).groupBy(key, known.cast("long").alias("local_day")).agg(F.sum(label).alias("_s"), F.count(label).alias("_n"))
    days = rows.select(key, "local_day").distinct().join(sums, [key, "local_day"], "full")
    past = days.withColumns({"_ps": F.sum("_s").over(w), "_pn": F.sum("_n").over(w)}).select(key, "local_day", F.when(F.col("_pn") >= least, F.col("_ps") / F.col("_pn")).alias("train_mean"))
    return rows.join(past, [key, "local_day"], "left")


def rolling_select(rows: DataFrame, candidates: list[str], label: str, key: str, day: str, back: int = 3) -> DataFrame:
    """Every row with the candidate of lowest MAE over the previous `back` days that its key has, the first one to begin with."""
    per = rows.groupBy(key, day).agg(*(F.sum(F.abs(F.col(c) - F.col(label))).alias(c) for c in candidates), F.count("*").alias("_n"))
    w = Window.partitionBy(key).orderBy(day).rowsBetween(-back, -1)
    err = [F.sum(c).over(w) / F.sum("_n").over(w) for c in candidates]
    ranked = F.array_sort(F.array(*(F.struct(e.alias("e"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, (e, c) in enumerate(zip(err, candidates, strict=True)))))
    pick = per.select(key, day, F.when(err[0].isNull(), F.lit(candidates[0])).otherwise(ranked[0]["c"]).alias("selected"))
    chosen = rows.join(pick, [key, day])
    return chosen.withColumn("prediction", F.coalesce(*(F.when(F.col("selected") == c, F.col(c)) for c in candidates)))


def trapezoid(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """Membership rising from a to b and falling from c to d; an infinite edge never ends."""
    up = F.lit(1.0) if math.isinf(a) else (x - a) / (b - a)
    down = F.lit(1.0) if math.isinf(d) else (F.lit(float(d)) - x) / (d - c)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), up, down))


def levels(x: Column, cuts: tuple[float, float] = (20.0, 35.0), width: float = 5.0) -> dict[str, Column]:
    """A partition into light, moderate and heavy whose memberships add up to one."""
    (a, b), w, far = cuts, width, math.inf
    return {"light": trapezoid(x, -far, -far, a - w, a + w), "moderate": trapezoid(x, a - w, a + w, b - w, b + w), "heavy": trapezoid(x, b - w, b + w, far, far)}


def trend_terms(x: Column) -> dict[str, Column]:
    far = math.inf
    return {"falling": trapezoid(x, -far, -far, -5, -1), "steady": trapezoid(x, -5, -1, 1, 5), "rising": trapezoid(x, 1, 5, far, far)}


def fuzzy_rules(rows: DataFrame, terms: dict[str, dict[str, Column]], label: str, support: float = 2.0) -> DataFrame:
    """Rules of a fuzzy classifier: for each combination of terms the class of most compatibility, its certainty and support.

    rows explode to the combinations that fire at all; the sums are one aggregation over (rule, class).
    """
    fired = _fired(rows, terms)
    sums = fired.groupBy("rule", F.col(label).alias("class")).agg(F.sum("strength").alias("s"))
    per = sums.groupBy("rule").agg(F.sum("s").alias("support"), F.max(F.struct("s", F.col("class"))).alias("m"), F.count("*").alias("_k"))
    certainty = F.col("m.s") / F.col("support")
    return per.filter(F.col("support") >= support).select("rule", F.col("m.class").alias("class"), certainty.alias("certainty"), "support")


def _fired(rows: DataFrame, terms: dict[str, dict[str, Column]]) -> DataFrame:
    out = rows.withColumns({"rule": F.lit(""), "strength": F.lit(1.0)})
    for name, own in terms.items():
        out = out.withColumn("_t", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("m")) for k, v in own.items())))).filter("_t.m > 0")
        out = out.withColumns({"rule": F.concat_ws("|", F.col("rule"), F.concat_ws("=", F.lit(name), F.col("_t.k"))), "strength": F.col("strength") * F.col("_t.m")}).drop("_t")
    return out


def fuzzy_predict(rows: DataFrame, terms: dict[str, dict[str, Column]], rules: DataFrame, key: str, fallback: str) -> DataFrame:
    """The class of the rule with the largest strength times certainty; the fallback column where none fires."""
    best = _fired(rows, terms).select(key, "rule", "strength").join(rules, "rule").groupBy(key).agg(F.max(F.struct((F.col("strength") * F.col("certainty")).alias("w"), "class")).alias("b"))
    return rows.join(best, key, "left").withColumn("predicted_class", F.coalesce("b.class", fallback)).drop("b")


def c_means(rows: DataFrame, features: list[str], k: int, m: float = 2.0, rounds: int = 25, tolerance: float = 1e-6) -> np.ndarray:
    """Fuzzy c-means centres, ordered by the first feature: one aggregation per round; begins at quantiles of the first feature."""
    stats = rows.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(features)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features))).first()
    mean, sd = np.array([stats[f"m{i}"] for i in range(len(features))]), np.array([stats[f"s{i}"] or 1.0 for i in range(len(features))])
    z = rows.select(*(((F.col(c) - float(mean[i])) / float(sd[i])).alias(f"z{i}") for i, c in enumerate(features))).na.drop().persist()
    cuts = z.agg(F.percentile("z0", [(i + 0.5) / k for i in range(k)]).alias("q")).first()["q"]
    centres = np.array([[q] + [0.0] * (len(features) - 1) for q in cuts])
    for _ in range(rounds):
        u = [F.pow(v, m) for v in memberships([F.col(f"z{i}") for i in range(len(features))], centres, m)]
        r = z.agg(*(F.sum(u[j]).alias(f"n{j}") for j in range(k)), *(F.sum(u[j] * F.col(f"z{i}")).alias(f"x{j}_{i}") for j in range(k) for i in range(len(features)))).first()
        new = np.array([[r[f"x{j}_{i}"] / r[f"n{j}"] for i in range(len(features))] for j in range(k)])
        moved, centres = float(np.abs(new - centres).max()), new
        if moved < tolerance:
            break
    z.unpersist()
    out = centres * sd + mean
    return out[np.argsort(out[:, 0])]


def memberships(x: list[Column], centres: np.ndarray, m: float = 2.0) -> list[Column]:
    """Fuzzy membership of a point in each centre."""
    d = [sum(((v - float(c)) * (v - float(c)) for v, c in zip(x, row, strict=True)), F.lit(1e-12)) for row in centres]
    inverse = [F.pow(v, -1.0 / (m - 1)) for v in d]
    total = sum(inverse[1:], inverse[0])
    return [v / total for v in inverse]


def fallback_chain(rows: DataFrame, chain: list[str]) -> DataFrame:
    """served and served_by: the first candidate of the chain that isn't null."""
    return rows.withColumns({"served": F.coalesce(*chain), "served_by": F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in chain))})


def residual_table(rows: DataFrame, forecast: str, persistence: str, label: str, key: str, alpha: float = 1.0) -> DataFrame:
    """(key, weights): slope and intercept of each key's residual on forecast less persistence."""
    own = rows.withColumn("_r", F.col(label) - F.col(forecast))
    return ridge_table(own, [F.col(forecast) - F.col(persistence)], "_r", key, alpha)


def with_residuals(rows: DataFrame, table: DataFrame, forecast: str, persistence: str, key: str) -> DataFrame:
    """calibrated and status: the forecast corrected by its key's weights, or as it is where there are none."""
    w = F.col("weights")
    correction = w[0] * (F.col(forecast) - F.col(persistence)) + w[1]
    return rows.join(table, key, "left").withColumns({"calibrated": F.col(forecast) + F.coalesce(correction, F.lit(0.0)), "status": F.when(w.isNull(), "uncorrected").otherwise("corrected")}).drop("weights")


def to_json_model(table: DataFrame, features: list[str], key: str) -> DataFrame:
    """(key, model): names of features and weights (the intercept last) as JSON."""
    return table.select(key, F.to_json(F.struct(F.array(*map(F.lit, features)).alias("features"), "weights")).alias("model"))


def from_json_model(models: DataFrame, features: list[str]) -> DataFrame:
    """The models read back: (.., features, weights); an error where the names or the number of weights are others."""
    m = F.from_json("model", "features array<string>, weights array<double>")
    out = models.select(*(c for c in models.columns if c != "model"), m["features"].alias("features"), m["weights"].alias("weights"))
    ok = F.coalesce((F.array_join("features", ",") == ",".join(features)) & (F.size("weights") == len(features) + 1), F.lit(False))
    if n := out.filter(~ok).count():
        raise ValueError(f"{n} models have other features or shapes")
    return out
