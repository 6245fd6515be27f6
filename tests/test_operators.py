"""Known answers of the operators that SQL can't check, and of the awkward cases."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from binweave.operators import asof, bins, calendar, detect, joins, lags, metrics, models, stacks, shaping, significance
from binweave.sources import readers, sinks


def series(spark, values, key="a", first=0):
    return spark.createDataFrame([(key, first + i, None if v is None else float(v)) for i, v in enumerate(values)], "route string, bin long, y double")


def test_hand_values_of_timed_features(spark):
    """Bin i has mean 20 + i from Sunday 2026-09-20 00:00 UTC on."""
    first = 1789862400 // 600
    rows = [("a", first + i, 20.0 + i) for i in range(32)]

    def at(missing, i):
        b = spark.createDataFrame([r for r in rows if r[1] - first not in missing], "route string, bin long, y double")
        return lags.timed_features(bins.with_after_gap(bins.with_gap(b))).filter(F.col("bin") == first + i).first()

    r = at([], 10)
    assert (r.y_persistence, r.lag_10, r.lag_60, r.roll_mean_30, r.slope_30, r.y_30, r.y_60) == (30, 29, 24, 28, 3, 33, 36)
    assert at([13], 10).y_30 is None and at([13], 14).lag_10 is None
    assert at([20, 21, 22, 23], 24).after_gap == 1 and at([20, 21, 22, 23], 24).lag_60 is None and at([20, 21, 22, 23], 31).after_gap == 0
    c = calendar.with_calendar(spark.createDataFrame([(first,)], "bin long")).first()
    assert (c.dow, c.is_weekend, c.is_morning_peak, c.tod_block) == (1, 1, 1, 96)


def test_slew_limit(spark):
    get = lambda v: [r.limited for r in shaping.slew_limited(series(spark, v), 300).orderBy("bin").collect()]
    assert get([0, 500, 0]) == [0, 300, 0]
    assert get([0, None, 900, 950]) == [0, None, 900, 950]


def test_rain_sums(spark):
    t0 = 1_000_000_200
    readings = spark.createDataFrame([("s", t0 + 300 * i, 1.0 if 30 <= i <= 35 else 0.0) for i in range(60)], "k string, t long, value double")
    points = spark.createDataFrame([("s", t0 + 180 * 60), ("s", t0 + 150 * 60), ("s", t0 - 99999)], "k string, t long")
    get = lambda w: {r.t - t0: r.total for r in asof.trailing_sum(points, readings, w, "k").collect()}
    assert get(1800)[10800] == 5 and get(3600)[10800] == 6 and get(1800)[9000] == 1 and get(3600)[9000] == 1 and get(1800)[-99999] is None


def test_asof_against_brute_force(spark):
    rng = random.Random(1)
    left = [(i, rng.choice("ab"), rng.randrange(5000)) for i in range(200)]
    right = [(rng.choice("ab"), rng.randrange(5000), rng.randrange(100)) for _ in range(80)]
    for bucket, tolerance in ((100, None), (10**6, 60)):
        out = asof.asof(spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "k string, rt long, v long"), "k", "t", "rt", ["v"], tolerance, bucket)
        got = {r.id: (r.v, r.asof_age) for r in out.collect()}
        for i, k, t in left:
            best = max(((rt, v) for rk, rt, v in right if rk == k and rt <= t), default=None)
            ok = best and (tolerance is None or t - best[0] <= tolerance)
            assert got[i] == ((best[1], t - best[0]) if ok else (None, None))


def test_forecast_validity_hand_values(spark):
    m = 60
    right = spark.createDataFrame([("x", 135 * m, 120 * m, 240 * m, 0.0), ("x", 150 * m, 120 * m, 240 * m, 1.0), ("x", 0, 0, 120 * m, 0.0)], "k string, available long, start long, stop long, flag double")
    left = spark.createDataFrame([("x", 130 * m, 130 * m), ("x", 140 * m, 140 * m), ("x", 160 * m, 160 * m)], "k string, t long, target long")
    got = {r.t: r.flag for r in asof.asof_valid(left, right, "k", "t", "target").collect()}
    assert got == {130 * m: None, 140 * m: 0.0, 160 * m: 1.0}


def test_midpoints_and_carry(spark):
    p = spark.createDataFrame([("r", 0, 1800.0), ("r", 600, 2001.0), ("r", 1140, 1.0), ("r", 1620, 5.0)], "k string, t long, y double")
    got = sorted((r.t, r.y) for r in shaping.midpoints(p, "k").filter("interpolated = 1").collect())
    assert [t for t, _ in got] == [300, 900] and got[0][1] == 1900.5
    ok = spark.createDataFrame([("r", 0, 1.0)], "k string, t long, y double")
    assert [shaping.carried_forward(ok, s).count() for s in (600, 1200, 1800)] == [1, 2, 3]


def test_wavelet_is_orthonormal():
    m = shaping.wavelet_matrix(36)
    assert m.shape[1] == 36 and np.allclose(shaping.wavelet_matrix(8) @ shaping.wavelet_matrix(8).T, np.eye(8))
    assert np.allclose((m @ np.ones(36))[9:], 0) and np.allclose((m @ np.ones(36))[:9], 2)


def test_z_score_and_mapping(spark):
    r = spark.createDataFrame([([1.0, 2.0, 3.0],), ([5.0, 5.0, 5.0],)], "x array<double>").select(shaping.z_scored(F.col("x")).alias("z"), shaping.mapped(F.col("x"), np.array([[1, 1, 0], [0, 0, 2]])).alias("m")).collect()
    assert np.allclose(r[0].z, [-1.224744871, 0, 1.224744871]) and r[1].z == [0, 0, 0] and r[0].m == [3, 6]


def test_t_distribution_and_diebold_mariano():
    for t in (-3.0, -0.4, 0.0, 0.7, 5.0):
        assert math.isclose(significance.t_cdf(t, 1), 0.5 + math.atan(t) / math.pi, abs_tol=1e-12)
        assert math.isclose(significance.t_cdf(t, 2), 0.5 + t / (2 * math.sqrt(2 + t * t)), abs_tol=1e-12)
    d = np.array([0.3, -0.1, 0.5, 0.2, 0.9, -0.4, 0.1, 0.6])
    stat, _, two = significance.diebold_mariano(d.mean(), d.var() / len(d), len(d), 1)
    t = d.mean() / (d.std(ddof=1) / math.sqrt(len(d)))
    assert math.isclose(stat, t, rel_tol=1e-12) and math.isclose(two, 2 * (1 - significance.t_cdf(abs(t), 7)), rel_tol=1e-9)
    assert significance.diebold_mariano(1, 0, 9) == (0.0, 0.5, 0.5) and math.isnan(significance.diebold_mariano(1, 1, 2)[0])


def test_hac_stays_within_groups(spark):
    rows = [("a", i, float(v)) for i, v in enumerate([1, 2, 3])] + [("b", i, float(v)) for i, v in enumerate([10, 11, 12])]
    r = significance.hac_variance(spark.createDataFrame(rows, "g string, i int, d double"), "g", "i", 1).first()
    e = np.array([v for *_, v in rows]) - np.mean([v for *_, v in rows])
    want = (e @ e + 2 * 0.5 * (e[0] * e[1] + e[1] * e[2] + e[3] * e[4] + e[4] * e[5])) / 36
    assert math.isclose(r.variance, want, rel_tol=1e-12) and r.n == 6


def test_holm(spark):
    rows = [("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", float("nan")), ("e", None), ("f", 0.9)]
    got = {r.id: r.adjusted for r in significance.holm(spark.createDataFrame(rows, "id string, p double")).collect()}
    assert got["d"] is None and got["e"] is None
    assert [round(got[k], 12) for k in "acbf"] == [0.04, 0.09, 0.09, 0.9]


def test_bootstraps(spark):
    from binweave.operators import comparison

    rows = spark.createDataFrame([("a", i, float(i % 4 + 1)) for i in range(40)], "g string, i int, d double")
    r = comparison.block_bootstrap(rows, "g", "i", 3, draws=300).first()
    assert r.n == 40 and r.low < r["mean"] == 2.5 < r.high
    flat = spark.createDataFrame([(g, i, 1.0) for g, n in (("a", 5), ("b", 4)) for i in range(n)], "g string, i int, d double")
    assert tuple(comparison.block_bootstrap(flat, "g", "i", 2, draws=50).first())[1:] == (1.0, 1.0, 1.0)
    mean, low, high = significance.day_bootstrap(spark.createDataFrame([(k, float(k % 3)) for k in range(30)], "day int, d double"), "day", 300)
    assert low <= mean <= high


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(3, 2, (60, 3))
    y = x @ [1, -2, 0.5] + rng.normal(0, 1, 60)
    df = spark.createDataFrame([("k", *map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "k string, a double, b double, c double, y double")
    by = {r.a: r.p for r in models.with_ridge(df, ["a", "b", "c"], "y", "k", 2.0, out="p").collect()}
    got = np.array([by[float(r[0])] for r in x])
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 2 * np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(got, z @ w + y.mean())


def test_simplex_weights_are_near_the_best():
    rng = np.random.default_rng(2)
    for k in (2, 3):
        p = rng.normal(0, 1, (80, k))
        y = p @ rng.dirichlet(np.ones(k)) + rng.normal(0, 0.3, 80)
        w = stacks.convex_weights(p, y)[0]
        grid = [v for v in itertools.product(np.linspace(0, 1, 51), repeat=k) if abs(sum(v) - 1) < 1e-9]
        best = min(np.abs(p @ np.array(v) - y).mean() for v in grid)
        assert w.min() >= 0 and abs(w.sum() - 1) < 1e-9 and np.abs(p @ w - y).mean() <= best * 1.01
    assert np.allclose(stacks.convex_weights(np.zeros((0, 4)), np.zeros(0))[0], 0.25)


def test_memberships_add_up(spark):
    r = spark.range(0, 60).select(*(v.alias(k) for k, v in models.levels(F.col("id").cast("double")).items())).collect()
    assert all(abs(sum(x) - 1) < 1e-9 for x in r)
    u = spark.createDataFrame([(1.0,), (4.0,)], "x double").select(*(v.alias(f"u{i}") for i, v in enumerate(models.memberships([F.col("x")], np.array([[0.0], [4.0]]))))).collect()
    assert abs(u[0].u0 - 0.9) < 1e-6 and abs(u[1].u1 - 1) < 1e-6


def test_c_means(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 0.3, 60) for m in (0, 5, 9)])
    c = models.c_means(spark.createDataFrame([(float(v),) for v in x], "x double"), ["x"], 3)
    assert np.allclose(c[:, 0], [0, 5, 9], atol=0.3)


def test_profile_errors_equal_refits(spark):
    rng = random.Random(0)
    rows = [("a" if i % 2 else "b", i % 5, 10 * (i % 144), int(i % 7 > 4), rng.gauss(20, 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "route string, fold long, tod_min long, is_weekend long, y double")
    got = {r.harmonics: r.mae for r in models.profile_errors(df, "y", "route", (1, 2)).collect()}
    for k in (1, 2):
        e = []
        for f in range(5):
            out = models.with_fourier(df.filter(F.col("fold") == f), "y", "route", k, train=df.filter(F.col("fold") != f))
            e += [abs(r.profile - r.y) for r in out.collect()]
        assert math.isclose(got[k], np.mean(e), rel_tol=1e-9)


BOX = "id long, frame long, cls string, x double, y double, w double, h double, confidence double"


def test_detections(spark):
    rows = [(1, 1, "car", 10, 10, 10, 10, 0.9), (2, 1, "car", 11, 10, 10, 10, 0.8), (3, 1, "bus", 11, 10, 10, 10, 0.7), (4, 1, "car", 50, 50, 4, 4, 0.6), (5, 2, "car", 10, 10, 10, 10, 0.5)]
    b = spark.createDataFrame([(*r[:3], *map(float, r[3:])) for r in rows], BOX)
    assert sorted(r.id for r in detect.suppressed(b, 0.7).collect()) == [1, 3, 4, 5]
    assert sorted(r.id for r in detect.suppressed(b, 0.6, by_class=False, smaller=True).collect()) == [1, 4, 5]
    truth = b.filter("id in (1, 4)")
    hits = {r.id: r.hit for r in detect.matched(truth, b, 0.5).collect()}
    assert hits == {1: True, 2: False, 3: False, 4: True, 5: False}
    ap = {r.cls: r.ap for r in detect.average_precision(detect.matched(truth, b, 0.5), truth).collect()}
    assert math.isclose(ap["car"], (51 * 1 + 50 * 2 / 3) / 101)
    with pytest.raises(ValueError):
        detect.directed(b, [(5, 1), (5, 2)])


def test_key_checks(spark):
    a, b = spark.createDataFrame([(1, 2)], "k long, v long"), spark.createDataFrame([(1, 3), (2, 4)], "k long, w long")
    with pytest.raises(ValueError, match="1 only right"):
        joins.aligned(a, b, ["k"])
    with pytest.raises(ValueError, match="duplicate"):
        joins.require_unique(a.unionAll(a), ["k"], "a")
    kept, missing = joins.with_predictions(b, {"m": a.select("k", F.col("v").alias("predicted"))}, ["k"])
    assert kept.count() == 1 and missing.first().m == 1


def test_ranked_probability(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0, 0), (0.0, 0.0, 1.0, 0)], "a double, b double, c double, l int")
    assert [r[0] for r in df.select(metrics.ranked_probability(["a", "b", "c"], "l")).collect()] == [0.0, 1.0]


def test_instants(spark):
    texts = ["2026-09-20T08:00:00+08:00", "2026-09-20 08:00:00", "20260920_080000", "20260920080000", "1789862400", "1789862400000", "2026-09-20T00:00:00Z", "nonsense", "1970-01-01 00:00:00", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_seconds(readers.instant(F.col("t"), "Asia/Singapore")).alias("s"))
    assert [r.s for r in df.collect()] == [1789862400] * 7 + [None] * 3


def test_readers(spark, tmp_path):
    (tmp_path / "rain.csv").write_text("timestamp,station_id,value_mm\n2026-01-01T00:00:00Z,a,1.5\n2026-01-01T00:00:00Z,a,9\nbad,a,1\n2026-01-01T00:05:00Z,a,\n")
    assert [r.value_mm for r in readers.readings(spark, str(tmp_path / "rain.csv")).collect()] == [1.5]
    (tmp_path / "f.csv").write_text("issue_timestamp,valid_start,valid_end,area,forecast,update_timestamp\n2026-01-01T00:00:00Z,2026-01-01T00:00:00Z,2026-01-01T02:00:00Z,x,Heavy Thundery Showers,\n2026-01-01T00:00:00Z,2026-01-01T00:00:00Z,2026-01-01T02:00:00Z,x,Fair,2025-12-31T00:00:00Z\n")
    rows = readers.forecasts(spark, str(tmp_path / "f.csv")).orderBy("heavy").collect()
    assert [(r.rain, r.heavy, (r.available_at - r.issue_timestamp).seconds) for r in rows] == [(0, 0, 0), (1, 1, 600)]
    (tmp_path / "p.json").write_text('{"items":[{"timestamp":"2026-01-01T00:00:00Z","readings":[{"station_id":"a","value":1},{"station_id":"b","value":2}]}],"stations":[{"id":"a","name":"old"},{"id":"a","name":"new"}]}')
    values, stations = readers.pages(spark, str(tmp_path / "p.json"))
    assert values.count() == 2 and [tuple(r) for r in stations.collect()] == [("a", "new")]
    good, bad = readers.payloads(spark.createDataFrame([('{"available":true,"camera_id":"c","a":4,"b":4,"unknown":2,"total":10}',), ('{"available":true,"camera_id":"c","a":4,"b":4,"unknown":2,"total":11}',), ("no",)], "j string"), "j")
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["total", "unreadable"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    path = str(tmp_path / "t")
    sinks.append_new(df, path, ["k"])
    sinks.append_new(df.unionAll(spark.createDataFrame([(3, "c")], df.schema)), path, ["k"])
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError):
        sinks.guarded_append(df, path, "k")
    sinks.upsert(spark.createDataFrame([(1, "new"), (9, "z")], df.schema), path, ["k"], str(tmp_path / "u"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "u")).collect()} == {(1, "new"), (2, "b"), (3, "c"), (9, "z")}
    assert sinks.fingerprints(spark, path + "/*.parquet").count() >= 1


def test_dense_fill_and_segment(spark):
    g = bins.dense(series(spark, [1, None, None, None, 5, None, 7]).na.drop())
    got = [r.y_filled for r in bins.filled(g, 2).orderBy("bin").collect()]
    assert got == [1, 1, 1, None, 5, 5, 7]
    assert [r.bin for r in bins.last_segment(bins.filled(g, 2)).orderBy("bin").collect()] == [4, 5, 6]
    assert [r.y_filled for r in bins.filled(g, 0).orderBy("bin").collect()] == [1, None, None, None, 5, None, 7]
    assert bins.filled(g, None).filter("y_filled is null").count() == 0
    assert bins.last_segment(bins.filled(g, 2), least=9).count() == 0
