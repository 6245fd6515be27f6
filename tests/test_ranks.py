"""Rank statistics against all pairs, Spark's percentile and window ranks."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from binweave.operators import metrics, ranks


def test_concordance_is_that_of_all_pairs():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 16, 33, 60):
        for span in (2, 5, 1000):
            x, y, c = rng.integers(0, span, n), rng.integers(0, span, n) / 4, rng.integers(1, 4, n)
            want = sum(int(np.sign(x[a] - x[b]) * np.sign(y[a] - y[b])) * int(c[a] * c[b]) for a, b in itertools.combinations(range(n), 2))
            assert ranks.concordance(x, y, c) == want


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k, n in (("hot", 700), ("b", 90), (None, 40), ("one", 1), ("two", 2), ("flat", 20)):
        for _ in range(n):
            x = 5.0 if k == "flat" or rng.random() < 0.4 else float(rng.integers(0, 300)) / 8  # 5.0 is a hot value
            rows.append((k, x, None if rng.random() < 0.05 else float(rng.normal(x, 9)) if rng.random() < 0.7 else 7.0))
    rows += [("none", None, None), ("nan", float("nan"), 1.0)]
    return rows, spark.createDataFrame(rows, "k string, x double, y double").repartition(6)


@pytest.mark.parametrize("parts", [2, 5, 64])
def test_kendall_matches_all_pairs(table, parts):
    rows, df = table
    got = {r.k: r for r in ranks.kendall(df, ["k"], "x", "y", parts).collect()}
    for k in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == k and None not in r and not any(v != v for v in r[1:])] if k is not None else [r[1:] for r in rows if r[0] is None and None not in r[1:]]
        if not own:
            assert k not in got
            continue
        pairs = [(np.sign(a[0] - b[0]), np.sign(a[1] - b[1])) for a, b in itertools.combinations(own, 2)]
        s, nx, ny, n = sum(a * b for a, b in pairs), sum(a != 0 for a, _ in pairs), sum(b != 0 for _, b in pairs), len(own)
        assert got[k].n == n
        if not nx * ny:
            assert got[k].tau is None
            continue
        assert got[k].tau == pytest.approx(s / math.sqrt(nx * ny))
        t, u = (np.unique([r[i] for r in own], return_counts=True)[1].astype(float) for i in (0, 1))
        v = (n * (n - 1) * (2 * n + 5) - sum(t * (t - 1) * (2 * t + 5)) - sum(u * (u - 1) * (2 * u + 5))) / 18 + sum(t * (t - 1)) * sum(u * (u - 1)) / (2 * n * (n - 1))
        v += sum(t * (t - 1) * (t - 2)) * sum(u * (u - 1) * (u - 2)) / (9 * n * (n - 1) * (n - 2)) if n > 2 else 0
        assert got[k].z == pytest.approx(s / math.sqrt(v)) and got[k].p == pytest.approx(math.erfc(abs(s / math.sqrt(v)) / math.sqrt(2)))


@pytest.mark.parametrize("parts", [2, 64])
def test_quantiles_are_sparks(table, parts):
    rows, df = table
    shares = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    wanted = {f"{c}{int(q * 100)}": (c, q) for c in "xy" for q in shares}
    clean = df.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    want = {r.k: r for r in clean.groupBy("k").agg(*(F.percentile(c, q).alias(name) for name, (c, q) in wanted.items())).collect()}
    got = {r.k: r for r in ranks.quantiles(df, ["k"], wanted, parts).collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        for name in wanted:
            assert got[k][name] == (None if r[name] is None else pytest.approx(r[name])), (k, name)
    all_ = ranks.quantiles(df, [], {"m": ("y", 0.5)}, parts).first().m
    assert all_ == pytest.approx(df.agg(F.percentile("y", 0.5)).first()[0])


def test_mean_ranks_and_spearman(table):
    rows, df = table
    got = {(r.k, r.y): r["rank"] for r in ranks.mean_ranks(df, ["k"], "y", 5).collect()}
    for k in ("hot", "b", None):
        own = sorted(r[2] for r in rows if r[0] == k and r[2] is not None)
        for v in set(own):
            assert got[k, v] == own.index(v) + (own.count(v) + 1) / 2


def test_no_task_holds_a_key(spark):
    """One key, a hot value in it: gaps between edges stay about a part of the rows each."""
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.hash("id").cast("double")).alias("x"))
    cuts = ranks.edges(df, ["x"])["x"]
    sizes = {r["b"]: r["n"] for r in df.groupBy(ranks.block(F.col("x"), cuts).alias("b")).agg(F.count("*").alias("n")).collect()}
    assert max(n for b, n in sizes.items() if b % 2 == 0) < 20_000 / ranks.PARTS * 2
    assert max(sizes, key=sizes.get) % 2 == 1  # the hot value is a block of its own


def test_empty(table):
    df = table[1].limit(0)
    assert ranks.kendall(df, ["k"], "x", "y").collect() == [] and ranks.quantiles(df, ["k"], {"m": ("x", 0.5)}).collect() == []
    assert metrics.correlations(df, "k", "x", "y").collect() == []


def test_validity_as_of_with_a_busy_key(spark):
    """One key over many time buckets, equal times, equal left rows, null keys: as a plain search, on any bucket width."""
    from binweave.operators import asof

    rng = np.random.default_rng(6)
    left = [(i, k, int(t), int(t + rng.integers(-900, 900))) for i, (k, t) in enumerate(zip(rng.choice(["hot", "b"], 120, p=[0.9, 0.1]), rng.integers(0, 5000, 120), strict=True))]
    left += [left[0], left[0], (500, "none", 100, 100), (501, None, 100, 100)]
    right = sorted({("hot" if rng.random() < 0.9 else "b", int(a), int(a - 300), int(a + rng.integers(0, 1200))) for a in rng.integers(0, 5000, 150)})
    right = [(*r, float(i)) for i, r in enumerate(right)]
    l = spark.createDataFrame(left, "id long, k string, t long, target long").repartition(5)
    r = spark.createDataFrame(right, "k string, available long, start long, stop long, flag double").repartition(5)
    want = []
    for i, k, t, target in left:
        own = sorted((x for x in right if x[0] == k and x[1] <= t), key=lambda x: x[1:4])[-6:]
        valid = [x[4] for x in own if x[2] <= target < x[3]]
        want.append((i, valid[-1] if valid else None))
    for bucket in (50, 700, 10**6):
        got = asof.asof_valid(l, r, "k", "t", "target", 6, bucket).collect()
        assert sorted(((x.id, x.flag) for x in got), key=str) == sorted(want, key=str)
    numbers = asof.ranked(r, "k", "available", "start", "stop", bucket=50).collect()
    for k in ("hot", "b"):
        assert sorted(x["rank"] for x in numbers if x.k == k) == list(range(1, sum(y[0] == k for y in right) + 1))
