"""Networks trained by summed gradients over all rows: several outputs, seeds and penalties at once, no series in one task.

Rows become blocks of matrices that stay where Spark keeps them. A step sends all networks'
weights out, every task sums its blocks' gradients for all of them, and the sums come back: a
few thousand numbers a task, added up in tasks of their own where there are many. Adam moves
the weights in the driver. A step sees one of `batches` shares of the rows, drawn by a hash of
the row's id, so that training depends on neither partitions nor retries.

Outputs are differences from the origin's value at several horizons; a row without some of
them teaches the others. Of each network the weights of the epoch with the least error on held
days stay, of each seed the penalty that did best; forecasts are the mean over seeds, none
below the least label that was trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, SLOTS = 4096, 32
_BLOCKS = "share int, held boolean, n long, x binary, y binary"


@dataclass(frozen=True)
class Settings:
    hidden: tuple[int, ...] = (32, 16)
    seeds: tuple[int, ...] = (0, 1, 2, 3, 4)
    penalties: tuple[float, ...] = (1e-4, 1e-2)
    epochs: int = 20
    batches: int = 4
    rate: float = 0.01


def shapes(inputs: int, outputs: int, hidden: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Shapes of matrices and offsets in turn."""
    return [s for a, b in zip((inputs, *hidden), (*hidden, outputs), strict=True) for s in ((a, b), (b,))]


def unpacked(flat: np.ndarray, own: list[tuple[int, ...]]) -> list[np.ndarray]:
    out, at = [], 0
    for s in own:
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out


def first_weights(inputs: int, outputs: int, own: Settings) -> np.ndarray:
    """One row per seed and penalty; networks of one seed begin alike."""
    rows = []
    for seed in own.seeds:
        rng = np.random.default_rng(seed)
        parts = [rng.normal(0, (2 / s[0]) ** 0.5, s).ravel() if len(s) == 2 else np.zeros(s) for s in shapes(inputs, outputs, own.hidden)]
        rows += [np.concatenate(parts)] * len(own.penalties)
    return np.array(rows)


def forward(x: np.ndarray, w: list[np.ndarray]) -> list[np.ndarray]:
    """Outputs of all layers: ReLU but for the last."""
    out = [x]
    for i in range(0, len(w), 2):
        a = out[-1] @ w[i] + w[i + 1]
        out.append(np.maximum(a, 0) if i + 2 < len(w) else a)
    return out


def gradient(flat: np.ndarray, own: list[tuple[int, ...]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of one network the sum over rows and outputs that are there of the squared error's gradient."""
    w = unpacked(flat, own)
    layers = forward(x, w)
    e = np.where(np.isnan(y), 0, 2 * (layers[-1] - np.nan_to_num(y)))
    grads: list[np.ndarray] = [np.zeros(0)] * len(w)
    for i in range(len(w) - 2, -1, -2):
        grads[i], grads[i + 1] = layers[i // 2].T @ e, e.sum(axis=0)
        if i:
            e = (e @ w[i].T) * (layers[i // 2] > 0)
    return np.concatenate([g.ravel() for g in grads])


def _blocks(rows: DataFrame, features: list[str], labels: list[str], row_id: list[str], held: str, scale: tuple[np.ndarray, np.ndarray], batches: int) -> DataFrame:
    share = F.pmod(F.xxhash64(*row_id), F.lit(batches)).cast("int")
    slim = rows.select(share.alias("_share"), F.col(held).cast("boolean").alias("_held"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)), *(F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(labels)))
    mean, sd = scale

    def pack(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches_:
            for (s, h), own in b.groupby(["_share", "_held"], sort=True):
                for at in range(0, len(own), BLOCK):
                    part = own.iloc[at : at + BLOCK]
                    x = (part[[f"x{i}" for i in range(len(features))]].to_numpy(float) - mean) / sd
                    y = part[[f"y{i}" for i in range(len(labels))]].to_numpy(float)
                    yield pd.DataFrame({"share": [s], "held": [h], "n": [len(part)], "x": [x.tobytes()], "y": [y.tobytes()]})

    return slim.mapInPandas(pack, _BLOCKS)


def _summed(blocks: DataFrame, each, width: int, tasks: int) -> np.ndarray:
    """The sum over blocks of each(x, y), a vector of `width`; a task's blocks are summed where they are."""

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros(width), False
        for b in batches:
            for x, y, n in zip(b["x"], b["y"], b["n"], strict=True):
                total += each(np.frombuffer(x).reshape(n, -1), np.frombuffer(y).reshape(n, -1))
                seen = True
        if seen:
            yield pd.DataFrame({"v": [total.tobytes()]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"v": [sum(np.frombuffer(v) for v in pdf["v"]).tobytes()]})

    parts = blocks.mapInPandas(own, "v binary")
    if tasks > SLOTS:
        parts = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(SLOTS))).applyInPandas(added, "v binary")
    return sum((np.frombuffer(r.v) for r in parts.collect()), np.zeros(width))  # one vector a task, SLOTS at most


def fit(rows: DataFrame, features: list[str], labels: list[str], origin: str, row_id: list[str], held: str, settings: Settings = Settings()) -> dict | None:
    """A model (weights of the kept networks, scaling, floor) from rows whose features are all there; None without any to train on.

    labels: absolute values; they are learned as differences from `origin`. held: true for rows that choose epoch and penalty.
    """
    own = settings
    ready = rows.filter(F.col(held).isNotNull() & F.col(origin).isNotNull())
    for c in features:
        ready = ready.filter(F.col(c).isNotNull())
    ready = ready.withColumns({f"_y{i}": F.col(c) - F.col(origin) for i, c in enumerate(labels)})
    train = ready.filter(~F.col(held))
    s = train.agg(F.count("*").alias("n"), F.min(F.least(*labels, *labels[:1])).alias("floor"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(features)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features))).first()
    if not s["n"]:
        return None
    mean, sd = np.array([s[f"m{i}"] for i in range(len(features))], float), np.array([s[f"s{i}"] or 1.0 for i in range(len(features))], float)
    blocks = _blocks(ready, features, [f"_y{i}" for i in range(len(labels))], row_id, held, (mean, sd), own.batches).persist()
    tasks = blocks.select(F.spark_partition_id().alias("p")).distinct().count()
    counts = {(r["share"], r["held"]): r["n"] for r in blocks.groupBy("share", "held").agg(F.sum("n").alias("n")).collect()}
    judged = any(h for _, h in counts)
    layout = shapes(len(features), len(labels), own.hidden)
    w = first_weights(len(features), len(labels), own)
    penalty = np.tile(own.penalties, len(own.seeds))[:, None]
    decayed = np.concatenate([np.full(int(np.prod(k)), float(len(k) == 2)) for k in layout])
    first, second, t = np.zeros_like(w), np.zeros_like(w), 0
    best, kept = np.full(len(w), np.inf), w.copy()
    for _ in range(own.epochs):
        for share in range(own.batches):
            n = counts.get((share, False), 0)
            if not n:
                continue
            at = w
            total = _summed(blocks.filter((F.col("share") == share) & ~F.col("held")), lambda x, y: np.concatenate([gradient(f, layout, x, y) for f in at]), w.size, tasks)  # noqa: B023
            g = total.reshape(w.shape) / n + penalty * decayed * w
            t += 1
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            w = w - own.rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        now = w
        test = blocks.filter("held") if judged else blocks
        error = _summed(test, lambda x, y: np.array([np.nansum(np.abs(forward(x, unpacked(f, layout))[-1] - y)) for f in now]), len(w), tasks)  # noqa: B023
        better = error < best
        best, kept = np.where(better, error, best), np.where(better[:, None], w, kept)
    blocks.unpersist()
    choice = best.reshape(len(own.seeds), -1).argmin(axis=1) + len(own.penalties) * np.arange(len(own.seeds))
    return {"weights": kept[choice].tolist(), "mean": mean.tolist(), "sd": sd.tolist(), "floor": s["floor"], "hidden": list(own.hidden), "outputs": len(labels)}


def predict(rows: DataFrame, model: dict | None, features: list[str], origin: str, names: list[str]) -> DataFrame:
    """rows with one forecast per output, null where a feature is or without a model. The model is a few thousand numbers and goes with the task."""
    if model is None:
        return rows.withColumns({n: F.lit(None).cast("double") for n in names})
    layout = shapes(len(features), model["outputs"], tuple(model["hidden"]))
    nets, mean, sd, floor = [np.array(f) for f in model["weights"]], np.array(model["mean"]), np.array(model["sd"]), model["floor"]

    @F.pandas_udf("array<double>")
    def score(x: pd.Series, start: pd.Series) -> pd.Series:
        v = (np.array([[np.nan if q is None else q for q in r] for r in x], float).reshape(len(x), -1) - mean) / sd
        out = sum(forward(v, unpacked(f, layout))[-1] for f in nets) / len(nets) + start.to_numpy(float)[:, None]
        return pd.Series([None if np.isnan(r).any() else np.maximum(r, floor).tolist() for r in out])

    made = rows.withColumn("_p", score(F.array(*(F.col(c).cast("double") for c in features)), F.col(origin).cast("double")))
    return made.withColumns({n: F.col("_p")[i] for i, n in enumerate(names)}).drop("_p")
