"""Convex stacks: weights of least absolute error for any number of members, exactly, with gates and rolling days.

The weights solve a linear program: minimise the weighted absolute residuals over the
simplex. A primal-dual interior point method solves it with one system as large as the
members per step, whatever the rows; it starts inside both feasible sets, so that its duality
gap bounds the distance from the optimum, and the gap goes with the weights. Where optima
are many, it returns the middle of their face (equal weights for equal members).

Folds are days of a series: a day's fit sees the rows of that series whose labels were known
before the day began. Rows are bins, of which a series has a fixed number a day, so that a
task's group (one series, or its last `back` days) grows with the calendar, not with events.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS, GAP = 100, 1e-10


def _longest(x: np.ndarray, dx: np.ndarray) -> float:
    """The longest step, up to 1, that keeps x positive."""
    down = dx < 0
    return min(1.0, float((-x[down] / dx[down]).min())) if down.any() else 1.0


def convex_weights(p: np.ndarray, y: np.ndarray, s: np.ndarray | None = None) -> tuple[np.ndarray, float, float]:
    """(weights, loss, lower bound): w >= 0 that add up to 1 and minimise sum s |y - p w|; equal weights without rows.

    loss - bound is the certified distance from the optimum: the bound is the value of a feasible dual solution.
    """
    k = p.shape[1]
    w = np.full(k, 1.0 / k)
    s = np.ones(len(y)) if s is None else np.asarray(s, float)
    own = s > 1e-9
    p, y, s = p[own].astype(float), y[own].astype(float), s[own]
    if not len(y):
        return w, 0.0, 0.0
    if k == 1:
        loss = float(s @ np.abs(y - p[:, 0]))
        return w, loss, loss
    shift = p.mean(axis=1)  # the weights add up to 1, so a row's common part drops out
    p, y = p - shift[:, None], y - shift
    scale, heaviest = max(float(np.abs(p).max()), float(np.abs(y).max()), 1e-300), float(s.max())
    a, b, c = p / scale, y / scale, s / heaviest
    e = b - a @ w
    over, under = np.maximum(e, 0) + 0.1, np.maximum(-e, 0) + 0.1
    d = 0.5 * c * np.clip(e, -1, 1)
    u, v = c - d, c + d
    level = -float((a.T @ d).max()) - 0.1
    z = -(a.T @ d) - level
    for _ in range(STEPS):
        gap = float(over @ u + under @ v + w @ z)
        if not np.isfinite(gap) or gap <= GAP * (1 + float(c @ np.abs(b - a @ w))):
            break
        spread = over / u + under / v
        inner = a / spread[:, None]
        system = np.block([[a.T @ inner + np.diag(z / w), -np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]])

        def newton(cw: np.ndarray, cu: np.ndarray, cv: np.ndarray):
            rest = cu / u - cv / v
            # both sets stay feasible, so the residuals of the constraints are zero but for rounding
            top = cw / w - inner.T @ rest
            x = np.linalg.lstsq(system, np.append(top, 1 - w.sum()), rcond=1e-15)[0]  # members may be alike
            dw, dl = x[:k], x[k]
            dd = -(rest + a @ dw) / spread
            return dw, (cu + over * dd) / u, (cv - under * dd) / v, dd, dl, -(a.T @ dd) - dl

        mu = gap / (2 * len(b) + k)
        dw, do, du_, dd, dl, dz = newton(-w * z, -over * u, -under * v)
        primal = min(_longest(w, dw), _longest(over, do), _longest(under, du_))
        dual = min(_longest(z, dz), _longest(u, -dd), _longest(v, dd))
        ahead = float((over + primal * do) @ (u - dual * dd) + (under + primal * du_) @ (v + dual * dd) + (w + primal * dw) @ (z + dual * dz))
        target = mu * (ahead / gap) ** 3
        dw, do, du_, dd, dl, dz = newton(target - w * z - dw * dz, target - over * u + do * dd, target - under * v - du_ * dd)
        primal = 0.9995 * min(_longest(w, dw), _longest(over, do), _longest(under, du_))
        dual = 0.9995 * min(_longest(z, dz), _longest(u, -dd), _longest(v, dd))
        w, over, under = w + primal * dw, over + primal * do, under + primal * du_
        d, level, z = d + dual * dd, level + dual * dl, z + dual * dz
        u, v = c - d, c + d
    w = np.where(w < 1e-9, 0.0, w)
    w /= w.sum()
    d = np.clip(d, -c, c)
    bound = (float(d @ b) - float((a.T @ d).max())) * scale * heaviest
    return w, float(s @ np.abs(y - p @ w)), bound


def known_day(bin_column: Column) -> Column:
    """The first day before whose end the label of a bin, 40 minutes on, is known."""
    return F.floor((bin_column * 600 + 2400 + 28800 - 1) / 86400)


def fitted_days(rows: DataFrame, members: list[str], label: str, key: str, day: str, known: str, gates: list[str] | None = None, least_days: int = 2, back: int | None = None) -> DataFrame:
    """One row per key, day and gate: fit_days, n (rows), weights, loss and bound (see convex_weights).

    Of a day, the rows whose `known` lies before it are fitted, those of the last `back` days only if given; with fewer than
    least_days of them the weights are equal. Rows with a null label or member are no part of a fit.
    """
    own = gates or ["_all"]
    slim = rows.select(key, F.col(day).cast("long").alias("_day"), F.col(known).cast("long").alias("_known"), F.col(label).cast("double").alias("_y"), *(F.col(m).cast("double").alias(m) for m in members), *(F.col(g).cast("double").alias(g) for g in gates or []))
    kind = rows.schema[key].dataType.simpleString()
    blank = [np.nan] * 2

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_known", "_day", "_y", *members], kind="stable")
        usable = pdf.dropna(subset=["_y", *members])
        p, y, seen, days = usable[members].to_numpy(float), usable["_y"].to_numpy(float), usable["_known"].to_numpy(), usable["_day"].to_numpy()
        degrees = [usable[g].fillna(0).to_numpy(float) if gates else np.ones(len(y)) for g in own]
        out = []
        for today in np.unique(pdf["_day"]):
            first = np.searchsorted(seen, today - back) if back else 0
            at = slice(first, np.searchsorted(seen, today))
            n = len(np.unique(days[at]))
            for g, s in zip(own, degrees, strict=True):
                w, loss, bound = convex_weights(p[at], y[at], s[at]) if n >= least_days else (np.full(len(members), 1 / len(members)), *blank)
                out.append((pdf[key].iloc[0], today, g, n, len(y[at]), w.tolist(), loss, bound))
        return pd.DataFrame(out, columns=[key, day, "gate", "fit_days", "n", "weights", "loss", "bound"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes for much work: adaptive execution must not join the partitions
    return slim.repartition(tasks, key).groupBy(key).applyInPandas(fit, f"{key} {kind}, {day} long, gate string, fit_days long, n long, weights array<double>, loss double, bound double")


def stacked(rows: DataFrame, members: list[str], label: str, key: str, day: str, known: str, gates: list[str] | None = None, least_days: int = 2, back: int | None = None) -> DataFrame:
    """Every row with `stack`: its members under its day's weights, summed over the gates by their degrees; null where a member is."""
    own = gates or ["_all"]
    fits = fitted_days(rows, members, label, key, day, known, gates, least_days, back).groupBy(key, day).agg(F.map_from_entries(F.collect_list(F.struct("gate", "weights"))).alias("_w"))  # one entry per gate
    mix = lambda g: sum((F.col(m) * F.element_at(F.element_at("_w", F.lit(g)), i + 1) for i, m in enumerate(members)), F.lit(0.0))
    value = sum(((F.col(g) if gates else F.lit(1.0)) * mix(g) for g in own), F.lit(0.0))
    return rows.join(fits, [key, day], "left").withColumn("stack", value).drop("_w")
