"""Histogram boosting over folds against a plain booster over rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from binweave.operators import boosting
from binweave.operators.boosting import GROUPS, Settings, Trees


def plain(x, y, group, own, seed):
    """Rows and masks only: predictions of a function from binned rows."""
    base = y.mean() if own.base is None else own.base
    shown, grown = np.full(len(y), base), []

    def leaf(g, h):
        return -own.rate * g / (h + own.penalty)

    def split(rows, drawn, g, columns, depth):
        own_g, own_h = sum(g[i] for i in rows if drawn[i]), sum(1 for i in rows if drawn[i])
        tried = []
        if depth:
            for missing_left in (False, True):
                for c in columns:
                    for b in range(1, x.max() + 1):
                        left = [i for i in rows if drawn[i] and (missing_left if x[i, c] == 0 else x[i, c] <= b)]
                        gl, hl = sum(g[i] for i in left), len(left)
                        if hl < own.least_weight or own_h - hl < own.least_weight:
                            continue
                        gain = 0.5 * (gl**2 / (hl + own.penalty) + (own_g - gl) ** 2 / (own_h - hl + own.penalty) - own_g**2 / (own_h + own.penalty))
                        tried.append((gain, (c, b, missing_left)))
        most = max((gain for gain, _ in tried), default=0)
        if most <= 1e-9:
            return leaf(own_g, own_h)
        c, b, missing_left = next(x for gain, x in tried if gain >= most - 1e-9 * (1 + most))
        to_left = {i: (missing_left if x[i, c] == 0 else x[i, c] <= b) for i in rows}
        return (c, b, missing_left, *(split([i for i in rows if to_left[i] == side], drawn, g, columns, depth - 1) for side in (True, False)))

    def value(tree, row):
        while isinstance(tree, tuple):
            c, b, missing_left, left, right = tree
            tree = left if (missing_left if row[c] == 0 else row[c] <= b) else right
        return tree

    for t in range(own.rounds):
        rng = np.random.default_rng([seed, t])
        drawn = np.isin(group, rng.permutation(GROUPS)[: max(1, round(own.row_share * GROUPS))])
        columns = sorted(rng.permutation(x.shape[1])[: max(1, round(own.column_share * x.shape[1]))])
        tree = split(range(len(y)), drawn, shown - y, columns, own.depth)
        grown.append(tree)
        shown = shown + np.array([value(tree, r) for r in x])
    return lambda rows: np.array([base + sum(value(t, r) for t in grown) for r in rows])


@pytest.mark.parametrize("seed", range(6))
def test_trees_are_those_of_a_plain_booster(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, (90, 3))
    y = x[:, 0] * 2.0 + (x[:, 1] > 3) * 5 - (x[:, 2] == 0) * 4 + rng.normal(0, 1, 90)
    group, own = rng.integers(0, GROUPS, 90), Settings(rounds=8, depth=3, rate=0.3, least_weight=(1.0, 5.0)[seed % 2], column_share=(1.0, 0.67)[seed % 2], base=(None, 0.5)[seed % 2])
    rows, back = np.unique(np.c_[x, group], axis=0, return_inverse=True)
    n, total = np.bincount(back).astype(float), np.bincount(back, y)
    got = Trees.grown(rows[:, :3], n, total, rows[:, 3], own, seed)
    fresh = rng.integers(0, 6, (40, 3))
    want = plain(x, y, group, own, seed)
    assert np.allclose(got.predict(x), want(x)) and np.allclose(got.predict(fresh), want(fresh))
    again = Trees.unpacked(own.rounds, *got.packed())
    assert np.array_equal(again.predict(fresh), got.predict(fresh))


def test_one_row_and_constant_labels():
    own = Settings(rounds=3)
    one = Trees.grown(np.array([[1, 0]]), np.array([1.0]), np.array([7.0]), np.array([0]), own, 0)
    assert one.predict(np.array([[1, 0], [0, 5]])) == pytest.approx([7, 7])
    flat = Trees.grown(np.arange(40).reshape(20, 2) % 5, np.ones(20), np.full(20, 3.0), np.arange(20) % 10, own, 0)
    assert flat.predict(np.array([[4, 4]])) == pytest.approx([3])


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    rows = []
    for route in ("a", "b"):
        for i in range(8 * 40):
            day, x = i // 40, float(rng.normal(20, 5))
            rows.append((route, i, day, day + (i % 40 > 36), x, None if rng.random() < 0.1 else float(rng.integers(0, 9)), x * (1 if route == "a" else -1) + float(rng.normal(0, 1)) if i % 11 else None))
    return rows, spark.createDataFrame(rows, "route string, i long, day long, known long, u double, v double, y double").repartition(5)


SMALL = dict(rounds=6, depth=2, rate=0.3, least_weight=2.0)
CALL = dict(label="y", day="day", known="known", row_id=["route", "i"])


def test_every_fold_is_fitted_on_what_was_known(spark, series):
    rows, df = series
    cuts = boosting.edges(df.filter("known < 3"), ["u", "v"], 8)
    early = [[r[4 + k] for r in rows if r[3] < 3 and r[4 + k] is not None] for k in (0, 1)]
    assert cuts == {c: pytest.approx(sorted(set(np.quantile(x, np.arange(1, 8) / 8)))) for c, x in zip("uv", early, strict=True)}
    coded = {(r.route, r.i): (r.c, r.g) for r in df.select("route", "i", boosting.cell(cuts).alias("c"), F.pmod(F.xxhash64("route", "i"), F.lit(GROUPS)).alias("g")).collect()}
    for r in rows:
        assert coded[r[0], r[1]][0] == [0 if v is None else 1 + sum(e <= v for e in cuts[c]) for c, v in zip("uv", r[4:6], strict=True)]
    got = {(r.route, r.i): r.trees for r in boosting.rolling_trees(df, ["u", "v"], keys=["route"], seeds=(0, 5), least=60, bins=8, **CALL, **SMALL).collect()}
    assert len(got) == len(rows)
    for route in ("a", "b"):
        for day in range(8):
            train = [r for r in rows if r[0] == route and r[3] < day and r[6] is not None]
            test = [r for r in rows if r[0] == route and r[2] == day]
            if day < 3 or len(train) < 60:
                assert all(got[r[0], r[1]] is None for r in test)
                continue
            code, group = (lambda own: np.array([coded[r[0], r[1]][0] for r in own])), np.array([coded[r[0], r[1]][1] for r in train])
            want = sum(plain(code(train), np.array([r[6] for r in train]), group, Settings(**SMALL), s)(code(test)) for s in (0, 5)) / 2
            assert np.allclose([got[r[0], r[1]] for r in test], want)


def test_same_on_any_partitioning_and_pooled(spark, series):
    rows, df = series
    run = lambda x, keys: {(r.route, r.i): r.trees for r in boosting.rolling_trees(x, ["u", "v"], keys=keys, least=60, bins=8, **CALL, **SMALL).collect()}
    assert run(df, ["route"]) == run(df.repartition(1), ["route"])
    pooled = run(df, [])
    assert pooled.keys() == {(r[0], r[1]) for r in rows} and pooled != run(df, ["route"])


def test_empty(series):
    assert boosting.rolling_trees(series[1].limit(0), ["u", "v"], keys=["route"], **CALL).collect() == []
    none = series[1].withColumn("y", F.lit(None).cast("double"))
    assert none.count() == boosting.rolling_trees(none, ["u", "v"], keys=["route"], **CALL).filter("trees is null").count()
