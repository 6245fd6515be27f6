"""Convex stacks: optima certified by their duality gap and by exchanges, rolling days, gates."""

import itertools

import numpy as np
import pytest

from binweave.operators import stacks

ALL = dict(key="k", day="day", known="known", label="y")


def loss(p, y, s, w):
    return float(s @ np.abs(y - p @ w))


def test_recovers_a_mix_and_respects_weights():
    rng = np.random.default_rng(0)
    p = rng.normal(20, 5, (300, 3))
    w, least, bound = stacks.convex_weights(p, p @ [0.7, 0.3, 0.0])
    assert np.allclose(w, [0.7, 0.3, 0.0], atol=1e-6) and least - bound < 1e-7
    p, y = np.array([[1.0, 0], [1, 0], [0, 1], [0, 1]]), np.ones(4)
    assert stacks.convex_weights(p, y, np.array([1, 1, 0, 0]))[0][0] == pytest.approx(1)
    assert stacks.convex_weights(p, y, np.array([0, 0, 1, 1]))[0][1] == pytest.approx(1)
    assert np.allclose(stacks.convex_weights(np.empty((0, 2)), np.empty(0))[0], 0.5)
    assert np.allclose(stacks.convex_weights(p, y, np.zeros(4))[0], 0.5)
    assert np.allclose(stacks.convex_weights(np.ones((5, 3)), np.zeros(5))[0], 1 / 3)  # alike members share


@pytest.mark.parametrize("seed", range(40))
def test_every_optimum_is_certified(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 400)), int(rng.integers(1, 6))
    base = rng.normal(30, 10, n)
    p, y = base[:, None] + rng.normal(0, 3, (n, k)) * rng.integers(0, 2, (n, k)), base + rng.standard_t(2, n) * 3
    if seed % 3 == 0:
        p, y = np.round(p), np.round(y)  # ties
    if seed % 5 == 0 and k > 1:
        p[:, 1] = p[:, 0]
    if seed % 7 == 0:
        p, y = p * 1e6, y * 1e6
    s = rng.random(n) * (rng.random(n) < 0.8)
    w, least, bound = stacks.convex_weights(p, y, s)
    assert w.min() >= 0 and w.sum() == pytest.approx(1)
    assert bound <= least + 1e-7 * (1 + least) and least - bound <= 1e-7 * (1 + least)
    for v in [*np.eye(k), *rng.dirichlet(np.ones(k), 200)]:
        assert least <= loss(p, y, s, v) + 1e-7 * (1 + least)


def test_vertices_of_three_members():
    """The optimum of a small program lies on a vertex; all of them are tried."""
    rng = np.random.default_rng(4)
    for _ in range(10):
        p, y, s = rng.normal(0, 2, (12, 3)), rng.normal(0, 1, 12), np.ones(12)
        lines = [*((row, v) for row, v in zip(p, y, strict=True)), *((e, 0.0) for e in np.eye(3))]
        best = np.inf
        for (a, b), (c, d) in itertools.combinations(lines, 2):
            m = np.array([a, c, np.ones(3)])
            if abs(np.linalg.det(m)) > 1e-9 and (w := np.linalg.solve(m, [b, d, 1])).min() >= -1e-9:
                best = min(best, loss(p, y, s, w))
        assert stacks.convex_weights(p, y, s)[1] == pytest.approx(best, abs=1e-7)


def frame(spark, days=6, per_day=12, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in ("a", "b"):
        for i in range(days * per_day):
            y = 20 + 5 * rng.random()
            heavy = float(rng.random())
            rows.append((k, i // per_day, i // per_day + (i % per_day == per_day - 1), i, y, y + 1 + rng.normal(), y + (5 if k == "a" else -5) + rng.normal(), y + rng.normal(0, 4), 20.0, 1 - heavy, heavy / 2, heavy / 2))
    return rows, spark.createDataFrame(rows, "k string, day long, known long, i long, y double, p double, q double, r double, c double, light double, mid double, heavy double")


MEMBERS, GATES = ["p", "q", "r", "c"], ["light", "mid", "heavy"]


def test_four_members_three_gates_all_folds(spark):
    rows, df = frame(spark)
    fits = stacks.fitted_days(df, MEMBERS, gates=GATES, **ALL).collect()
    assert len(fits) == 2 * 6 * 3
    table = np.array([r[4:] for r in rows])
    for f in fits:
        own = np.array([r[0] == f.k and r[2] < f.day for r in rows])
        assert f.fit_days == len({r[1] for r, o in zip(rows, own, strict=True) if o})
        if f.fit_days < 2:
            assert f.weights == [0.25] * 4
            continue
        p, y, s = table[own][:, 1:5], table[own][:, 0], table[own][:, 5 + GATES.index(f.gate)]
        assert loss(p, y, s, np.array(f.weights)) == pytest.approx(f.loss, rel=1e-9)
        assert -1e-7 <= f.loss - f.bound <= 1e-6 * (1 + f.loss)
    by = {(f.k, f.day, f.gate): np.array(f.weights) for f in fits}
    for r in stacks.stacked(df, MEMBERS, gates=GATES, **ALL).collect():
        want = sum(r[g] * float(np.array([r[m] for m in MEMBERS]) @ by[r.k, r.day, g]) for g in GATES)
        assert r.stack == pytest.approx(want)


def test_no_look_ahead_and_plain_gate(spark):
    rows, df = frame(spark, seed=1)
    later = spark.createDataFrame([(*r[:4], r[4] + 100 * (r[1] == 5), *r[5:]) for r in rows], df.schema)
    values = lambda x, **more: {(r.k, r.i): r.stack for r in stacks.stacked(x, MEMBERS, **ALL, **more).collect()}
    plain = values(df)
    assert plain == pytest.approx(values(later))
    ones = df.selectExpr("*", "1.0D as one", "0.0D as none")
    assert plain == pytest.approx(values(ones, gates=["one", "none"]), abs=1e-5)
    assert values(df, back=2) != plain


def test_nulls_and_empty(spark):
    rows, df = frame(spark)
    holes = spark.createDataFrame([(*r[:4], None if i % 7 == 0 else r[4], None if i % 5 == 0 else r[5], *r[6:]) for i, r in enumerate(rows)], df.schema)
    got = stacks.stacked(holes, MEMBERS, **ALL).collect()
    assert len(got) == len(rows) and all((r.stack is None) == (r.p is None) for r in got)
    assert stacks.stacked(df.limit(0), MEMBERS, **ALL).collect() == []
