"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian over the statistics, its covariance shrunk towards the
pooled one and its diagonal. The score is the posterior of class 1: the logistic
of the difference of log densities (Mahalanobis distances through the Cholesky
factors, computed once at the fit and shipped with the scorer) plus log priors.

Fit: the sums and products of the labelled rows are one Spark aggregation over all
of them; the driver only sees those (a few hundred numbers).

Defined results: null and empty texts have the statistics of the empty text and
get a score like any other; labels that are null, or other than 0 and 1, are not
learned from; repeated labels count as often as they stand, repeated documents too;
with one class, or none, every score is the prior of class 1 (0.5 with no labels).
Rows with null ids are scored but never learned from; an empty table gives no rows;
very long texts are counted whole; other columns are ignored, or kept by keep_good.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, held_out

# Byte classes.
_BYTES = np.zeros((6, 256))
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?!'\"()-", b"#$%&*|<>{}[]=+_~^\\/@`", b"\n")):
    _BYTES[_k, list(_chars)] = 1
STATS = "_binweave_stats"
NAMES = ["words", "word_chars", "upper", "digits", "punctuation", "symbols", "bangs", "newlines", "distinct", "repeats", "top_word", "shouts", "pipes", "distinct_lines"]


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text, in the order of NAMES."""
    text = text or ""
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits, punctuation, symbols, newlines = (_BYTES @ counts).tolist()
    size = len(raw) or 1
    words = text.split()
    n = len(words) or 1
    often = Counter(words)
    lines = [x for x in text.split("\n") if x]
    root = lambda x: float(np.sqrt(x))
    return [
        float(np.log1p(len(words))), float(np.log1p(len(text) / n)), root(upper / (upper + lower + 1)), root(digits / size), root(punctuation / size), root(symbols / size),
        root(int(counts[33]) / size), root(newlines / size), float(np.log((len(often) + 1) / (n + 1))), root(sum(map(eq, words, words[1:])) / n), root(max(often.values(), default=0) / n),
        root(sum(1 for w in words if len(w) > 3 and w.isupper()) / n), root(int(counts[124]) / size), root(len(set(lines)) / (len(lines) or 1)),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield pd.Series([statistics(x) for x in t], index=t.index)


@dataclass
class Discriminant:
    """means, inverse Cholesky factors and offsets (log prior less half the log determinant) of classes 0 and 1."""

    means: np.ndarray
    whiten: np.ndarray
    offset: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means.shape[0] < 2:
            return np.full(len(x), float(self.offset[0]))
        logs = [self.offset[k] - 0.5 * (((x - self.means[k]) @ self.whiten[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))


def fit(labelled: DataFrame, shrinkage: float = 0.1, diagonal: float = 0.05) -> Discriminant:
    """labelled(stats array<double>, label 0/1) -> the discriminant. One aggregation with map-side sums."""
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.col("stats")[i] for i in range(d)]
    rows = labelled.filter("label in (0, 1)").groupBy("label").agg(F.count("*").alias("n"), F.array(*(F.sum(v) for v in x)).alias("s"), F.array(*(F.sum(x[i] * x[j]) for i, j in pairs)).alias("p")).collect()
    if len(rows) < 2:
        return Discriminant(np.zeros((1, d)), np.zeros((1, d, d)), np.array([float(rows[0].label) if rows else 0.5]))
    rows.sort(key=lambda r: r.label)
    total = sum(r.n for r in rows)
    means, covs = [], []
    for r in rows:
        mean = np.array(r.s) / r.n
        second = np.zeros((d, d))
        for (i, j), v in zip(pairs, r.p, strict=True):
            second[i, j] = second[j, i] = v / r.n
        means.append(mean)
        covs.append(second - np.outer(mean, mean))
    pooled = sum(c * r.n for c, r in zip(covs, rows, strict=True)) / total
    whiten, offset = [], []
    for c, r in zip(covs, rows, strict=True):
        c = (1 - shrinkage) * c + shrinkage * pooled
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + 1e-6 * np.eye(d)
        low = np.linalg.cholesky(c)
        whiten.append(np.linalg.inv(low))
        offset.append(np.log(r.n / total) - np.log(np.diag(low)).sum())
    return Discriminant(np.array(means), np.array(whiten), np.array(offset))


def fit_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: list[str] | None = None) -> tuple[Discriminant, DataFrame]:
    """The discriminant of all labelled documents that aren't held out, and the kept columns of every document with its statistics (STATS).

    The statistics are computed once and written; the fit reads those of labelled rows, the scorer all.
    """
    stats = durable(docs.select(*(keep or ["doc_id"]), statistics_udf("text").alias(STATS)), "quality-stats")
    learn = labels.filter(~held_out()).select("doc_id", F.col(label).alias("label"))
    return fit(stats.select("doc_id", F.col(STATS).alias("stats")).join(learn, "doc_id")), stats


def score_stats(stats: Column, model: Discriminant) -> Column:
    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.vstack(x.to_list())) if len(x) else [], index=x.index, dtype=float)

    return score(stats)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted."""
    model, stats = fit_documents(docs, labels)
    scored = stats.select("doc_id", held_out().alias("held_out"), score_stats(F.col(STATS), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    model, beside = fit_documents(docs, labels, keep=docs.columns)
    return beside.filter(score_stats(F.col(STATS), model) >= threshold).drop(STATS)
