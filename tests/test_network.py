"""Data-parallel networks against a plain run of the same batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from binweave.operators import network
from binweave.operators.network import Settings

SMALL = Settings(hidden=(5, 3), seeds=(0, 7), penalties=(0.0, 0.1), epochs=4, batches=3, rate=0.05)


def plain(x, y, share, held, own):
    """Autograd by hand, net by net, rows in the order given."""
    layout = network.shapes(x.shape[1], y.shape[1], own.hidden)
    kept = []
    for s, start in zip(own.seeds, network.first_weights(x.shape[1], y.shape[1], own)[:: len(own.penalties)], strict=True):
        options = []
        for penalty in own.penalties:
            w = [a.copy() for a in network.unpacked(start, layout)]
            m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
            best = (np.inf, None)
            for _ in range(own.epochs):
                for b in range(own.batches):
                    at = np.flatnonzero((share == b) & ~held)
                    if not len(at):
                        continue
                    h1 = x[at] @ w[0] + w[1]
                    h2 = np.maximum(h1, 0) @ w[2] + w[3]
                    e = 2 * (np.maximum(h2, 0) @ w[4] + w[5] - y[at])
                    e[np.isnan(e)] = 0
                    d2 = (e @ w[4].T) * (h2 > 0)
                    d1 = (d2 @ w[2].T) * (h1 > 0)
                    g = [x[at].T @ d1, d1.sum(0), np.maximum(h1, 0).T @ d2, d2.sum(0), np.maximum(h2, 0).T @ e, e.sum(0)]
                    t += 1
                    for i in range(6):
                        gi = g[i] / len(at) + (penalty * w[i] if i % 2 == 0 else 0)
                        m[i], v[i] = 0.9 * m[i] + 0.1 * gi, 0.999 * v[i] + 0.001 * gi**2
                        w[i] = w[i] - own.rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
                test = held if held.any() else np.ones(len(x), bool)
                error = np.nansum(np.abs(network.forward(x[test], w)[-1] - y[test]))
                if error < best[0]:
                    best = (error, [a.copy() for a in w])
            options.append(best)
        kept.append(min(options, key=lambda o: o[0])[1])
    return kept


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(240):
        a, b = rng.normal(30, 8), rng.normal(0, 1)
        labels = [float(a + b * k + rng.normal(0, 0.3)) if rng.random() > 0.15 else None for k in (1, 2)]
        rows.append((i, float(a), None if i == 17 else float(b), *labels, i % 6 == 5))
    return rows, spark.createDataFrame(rows, "i long, a double, b double, l1 double, l2 double, held boolean")


def arrays(spark, rows, df):
    share = {r.i: r.s for r in df.select("i", F.pmod(F.xxhash64("i"), F.lit(SMALL.batches)).alias("s")).collect()}
    own = [r for r in rows if r[2] is not None]
    x = np.array([r[1:3] for r in own])
    y = np.array([[np.nan if v is None else v - r[1] for v in r[3:5]] for r in own])
    held = np.array([r[5] for r in own])
    mean, sd = x[~held].mean(0), x[~held].std(0)
    return own, (x - mean) / sd, y, np.array([share[r[0]] for r in own]), held


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_training_is_that_of_a_plain_run(spark, table, parts):
    rows, df = table
    own, z, y, share, held = arrays(spark, rows, df)
    nets = plain(z, y, share, held, SMALL)
    model = network.fit(df.repartition(parts), ["a", "b"], ["l1", "l2"], "a", ["i"], "held", SMALL)
    want = sum(network.forward(z, w)[-1] for w in nets) / len(nets) + np.array([r[1] for r in own])[:, None]
    floor = min(v for r in own if not r[5] for v in r[3:5] if v is not None)
    got = {r.i: (r.p1, r.p2) for r in network.predict(df, model, ["a", "b"], "a", ["p1", "p2"]).collect()}
    assert model["floor"] == floor and got.pop(17) == (None, None)
    assert np.allclose([got[r[0]] for r in own], np.maximum(want, floor), atol=1e-7)


def test_it_learns(spark, table):
    rows, df = table
    model = network.fit(df, ["a", "b"], ["l1", "l2"], "a", ["i"], "held", Settings(hidden=(8,), seeds=(0, 1), penalties=(1e-4,), epochs=25, batches=3, rate=0.05))
    out = network.predict(df, model, ["a", "b"], "a", ["p1", "p2"]).filter("held and l2 is not null")
    mae, naive = out.agg(F.avg(F.abs(F.col("p2") - F.col("l2"))), F.avg(F.abs(F.col("a") - F.col("l2")))).first()
    assert mae < 0.6 * naive


def test_without_rows(spark, table):
    df = table[1]
    assert network.fit(df.limit(0), ["a", "b"], ["l1"], "a", ["i"], "held", SMALL) is None
    assert network.predict(df, None, ["a", "b"], "a", ["p"]).filter("p is not null").count() == 0
    all_train = network.fit(df.withColumn("held", F.lit(False)), ["a"], ["l1"], "a", ["i"], "held", Settings(hidden=(2,), seeds=(0,), penalties=(0.0,), epochs=1, batches=2))
    assert len(all_train["weights"]) == 1
