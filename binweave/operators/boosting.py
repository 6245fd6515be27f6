"""Boosted trees for all folds and series at once, from histograms of binned rows.

Squared error needs of a row only its binned features and its label, so that rows collapse to
cells: one aggregation counts rows and sums labels per series, day, vector of bin numbers and
sampling group, with map-side sums. A fold's model grows from the cells of all days whose
labels were known before its day; every level of every tree is one histogram of gradients over
them. What a task holds is one model's cells: at most one per bin vector and group, however
many events lie behind them. (Spark jobs per level would be rounds x depth jobs in turn.)

Trees are those of the usual second-order booster: shrunk leaves with a penalty, splits of
best gain among bin edges, missing values on the better side, least weight of a child, columns
drawn per tree. Rows are drawn per tree by group: a row belongs to one of GROUPS groups by a
hash of its key, and a tree sees a share of the groups. Everything drawn depends on the seed
and the tree alone, never on partitions. Models are rows of a table: trees as arrays of bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUPS = 10


@dataclass(frozen=True)
class Settings:
    rounds: int = 300
    depth: int = 4
    rate: float = 0.05
    penalty: float = 1.0
    least_weight: float = 10.0
    row_share: float = 0.8
    column_share: float = 0.8
    base: float | None = None  # the mean label if not given


def edges(rows: DataFrame, features: list[str], bins: int = 32) -> dict[str, list[float]]:
    """Distinct inner quantiles of each feature; of rows that no fold tests, so that nothing later is in them."""
    q = [i / bins for i in range(1, bins)]
    got = rows.agg(*(F.percentile(F.col(c).cast("double"), q).alias(c) for c in features)).first()
    return {c: sorted(set(got[c] or [])) for c in features}


def cell(cuts: dict[str, list[float]]) -> Column:
    """A row's bin numbers: 0 for null, else one more than the edges at or below the value."""
    one = lambda c, own: F.when(F.col(c).isNull(), 0).otherwise(1 + sum(((F.col(c) >= F.lit(e)).cast("int") for e in own), F.lit(0)))
    return F.array(*(one(c, own).cast("int") for c, own in cuts.items()))


class Trees:
    """Complete trees of one model: for each inner node a feature (-1: all go left), the last bin of the left side, and where missing values go."""

    def __init__(self, feature: np.ndarray, last: np.ndarray, missing_left: np.ndarray, value: np.ndarray, base: float):
        self.feature, self.last, self.missing_left, self.value, self.base = feature, last, missing_left, value, base

    @classmethod
    def grown(cls, codes: np.ndarray, n: np.ndarray, total: np.ndarray, group: np.ndarray, settings: Settings, seed: int) -> Trees:
        """From cells: bin numbers (cells x features), rows, label sums, sampling groups."""
        own, m, width = settings, len(n), int(codes.max()) + 1
        inner, columns = 2**own.depth - 1, max(1, round(own.column_share * codes.shape[1]))
        feature, last = np.full((own.rounds, inner), -1, np.int32), np.zeros((own.rounds, inner), np.int32)
        missing, value = np.zeros((own.rounds, inner), bool), np.zeros((own.rounds, inner + 1))
        base = float(total.sum() / n.sum()) if own.base is None else own.base
        shown, share = np.full(m, base), max(1, round(own.row_share * GROUPS))
        for t in range(own.rounds):
            rng = np.random.default_rng([seed, t])
            drawn, picked = np.isin(group, rng.permutation(GROUPS)[:share]), np.sort(rng.permutation(codes.shape[1])[:columns])
            h = np.where(drawn, n, 0.0)
            g = np.where(drawn, shown * n - total, 0.0)
            at, place = np.zeros(m, np.int64), codes[:, picked] + width * np.arange(columns)
            g_all, h_all = np.repeat(g, columns), np.repeat(h, columns)
            for level in range(own.depth):
                nodes, first = 2**level, 2**level - 1
                where = (at[:, None] * (columns * width) + place).ravel()
                shape = (nodes, columns, width)
                gs = np.bincount(where, g_all, nodes * columns * width).reshape(shape)
                hs = np.bincount(where, h_all, nodes * columns * width).reshape(shape)
                best, split, side = _best(gs, hs, own)
                go = best > 1e-9
                if not go.any():
                    break
                column, b = split // (width - 1), split % (width - 1) + 1
                feature[t, first : first + nodes] = np.where(go, picked[column], -1)
                last[t, first : first + nodes], missing[t, first : first + nodes] = b, side
                code = codes[np.arange(m), picked[column][at]]
                right = go[at] & np.where(code == 0, ~side[at], code > b[at])
                at = 2 * at + right
            else:
                level = own.depth
            at <<= own.depth - level
            sums = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
            value[t] = -own.rate * sums[0] / (sums[1] + own.penalty)
            shown = shown + value[t][at]
        return cls(feature, last, missing, value, base)

    def predict(self, codes: np.ndarray) -> np.ndarray:
        rounds, inner = self.feature.shape
        at, tree = np.zeros((len(codes), rounds), np.int64), np.arange(rounds)
        for _ in range((inner + 1).bit_length() - 1):
            f = self.feature[tree, at]
            code = np.take_along_axis(codes, np.maximum(f, 0), axis=1)
            right = (f >= 0) & np.where(code == 0, ~self.missing_left[tree, at], code > self.last[tree, at])
            at = 2 * at + 1 + right
        return self.base + self.value[tree, at - inner].sum(axis=1)

    def packed(self) -> tuple:
        return self.feature.tobytes(), self.last.tobytes(), self.missing_left.tobytes(), self.value.tobytes(), self.base

    @classmethod
    def unpacked(cls, rounds: int, feature: bytes, last: bytes, missing_left: bytes, value: bytes, base: float) -> Trees:
        shaped = lambda raw, kind: np.frombuffer(raw, kind).reshape(rounds, -1)
        return cls(shaped(feature, np.int32), shaped(last, np.int32), shaped(missing_left, bool), shaped(value, float), base)


def _best(gs: np.ndarray, hs: np.ndarray, own: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node: the best gain, its split (column and bin as one number) and whether missing values go left; of equal ones the first, missing right before left."""
    nodes = len(gs)
    g, h = gs[:, 0].sum(axis=1)[:, None, None], hs[:, 0].sum(axis=1)[:, None, None]
    score = lambda a, b: a * a / (b + own.penalty)
    gains = []
    for with_missing in (0, 1):
        gl, hl = (np.cumsum(x[:, :, 1:], axis=2) + with_missing * x[:, :, :1] for x in (gs, hs))
        gr, hr = g - gl, h - hl
        gain = 0.5 * (score(gl, hl) + score(gr, hr) - score(g, h))
        gains.append(np.where((hl >= own.least_weight) & (hr >= own.least_weight), gain, -np.inf).reshape(nodes, -1))
    every = np.concatenate(gains, axis=1)
    most = every.max(axis=1)
    # sums in another order must not choose between equal gains
    at, row = (every >= (most - 1e-9 * (1 + np.abs(most)))[:, None]).argmax(axis=1), np.arange(nodes)
    half = gains[0].shape[1]
    return every[row, at], at % half, at >= half


_MODEL = "n long, feature binary, last binary, missing_left binary, value binary, base double"


def fitted_folds(rows: DataFrame, cuts: dict[str, list[float]], label: str, day: str, known: str, keys: list[str], row_id: list[str], settings: Settings = Settings(), seeds: tuple[int, ...] = (0,), least: int = 500, first: int | None = None) -> DataFrame:
    """One model per series (keys), test day (fold) and seed: fold, keys, seed, n (rows fitted), the trees.

    A fold is fitted on all rows of its series whose `known` lies before its day; folds with fewer than `least` rows, or before day `first`, have no model.
    """
    group = F.pmod(F.xxhash64(*row_id), F.lit(GROUPS)).cast("int")
    ready = rows.filter(F.col(label).isNotNull()).select(*keys, F.col(known).cast("long").alias("_known"), cell(cuts).alias("_cell"), group.alias("_group"), F.col(label).cast("double").alias("_y"))
    cells = ready.groupBy(*keys, "_known", "_cell", "_group").agg(F.count("*").alias("_n"), F.sum("_y").alias("_s"))
    folds = rows.select(*keys, F.col(day).cast("long").alias("fold")).distinct()  # one row per series and day
    if first is not None:
        folds = folds.filter(F.col("fold") >= first)
    last = folds.agg(F.max("fold")).first()[0]
    later = F.when(F.col("_known") < F.lit(last), F.sequence(F.col("_known") + 1, F.lit(last).cast("long")))
    train = cells.withColumn("fold", F.explode(later)).join(folds, [*keys, "fold"])
    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), "fold long, seed int", _MODEL])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["_n"].to_numpy(float)
        names = [*keys, "fold", "seed", *(x.split()[0] for x in _MODEL.split(", "))]
        if n.sum() < least:
            return pd.DataFrame([], columns=names)
        codes = np.stack(pdf["_cell"].to_numpy()).astype(np.int64)
        order = np.lexsort((pdf["_known"], pdf["_group"], *codes.T))  # the same sums on any plan
        codes, n, total, group = codes[order], n[order], pdf["_s"].to_numpy()[order], pdf["_group"].to_numpy()[order]
        head = [pdf[c].iloc[0] for c in (*keys, "fold")]
        return pd.DataFrame([(*head, s, int(n.sum()), *Trees.grown(codes, n, total, group, settings, s).packed()) for s in seeds], columns=names)

    # the cells are few bytes for much work, so that adaptive execution must not join the partitions
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return train.repartition(tasks, *keys, "fold").groupBy(*keys, "fold").applyInPandas(fit, schema)


def predicted(rows: DataFrame, models: DataFrame, cuts: dict[str, list[float]], day: str, keys: list[str], rounds: int, out: str = "trees") -> DataFrame:
    """Every row with the mean prediction of its day's models, null where there are none: the models meet one day of one series at a time."""
    schema = rows.withColumn(out, F.lit(None).cast("double")).schema
    coded = rows.withColumn("_cell", cell(cuts)).withColumn("_fold", F.col(day).cast("long"))

    def score(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame([], columns=schema.names)
        value = np.full(len(pdf), np.nan)
        if len(own):
            codes = np.stack(pdf["_cell"].to_numpy()).astype(np.int64)
            fitted = [Trees.unpacked(rounds, *r) for r in own.sort_values("seed")[["feature", "last", "missing_left", "value", "base"]].itertuples(index=False, name=None)]
            value = sum(m.predict(codes) for m in fitted) / len(fitted)
        return pdf.assign(**{out: pd.Series(value, index=pdf.index)})[schema.names]

    left, right = coded.groupBy(*keys, "_fold"), models.withColumnRenamed("fold", "_fold").groupBy(*keys, "_fold")
    made = left.cogroup(right).applyInPandas(score, schema)
    return made.withColumn(out, F.when(~F.isnan(out), F.col(out)))


def rolling_trees(rows: DataFrame, features: list[str], label: str, day: str, known: str, keys: list[str], row_id: list[str], out: str = "trees", **settings) -> DataFrame:
    """Every row with the out-of-sample prediction of trees refitted for its day; the first `warm` days only set the bin edges.

    settings: those of Settings, and seeds, least (200 rows of a series), warm (3 days) and bins (32).
    """
    seeds, least, warm, bins = (settings.pop(k, v) for k, v in (("seeds", (0,)), ("least", 200), ("warm", 3), ("bins", 32)))
    own = Settings(**settings)
    begin = rows.agg(F.min(day)).first()[0]
    if begin is None:
        return rows.withColumn(out, F.lit(None).cast("double"))
    cuts = edges(rows.filter(F.col(known) < begin + warm), features, bins)
    models = fitted_folds(rows, cuts, label, day, known, keys, row_id, own, seeds, least, begin + warm)
    return predicted(rows, models, cuts, day, keys, own.rounds, out)
