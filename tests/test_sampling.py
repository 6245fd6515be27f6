"""The seeded stratified sample: quotas, turns, any partitioning, shortfalls; wavelet steps against a plain transform."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from binweave.operators import sampling, shaping


def md5(*of):
    return hashlib.md5("/".join(map(str, of)).encode()).hexdigest()


def plain(rows, n, seed, buckets):
    base, extra = divmod(n, buckets)
    plus = set(sorted(range(buckets), key=lambda b: md5(seed, b))[:extra])
    out = set()
    for b in range(buckets):
        pools = {}
        for i, own, p in rows:
            if own == b:
                pools.setdefault(p, []).append(i)
        pools = {p: sorted(ids, key=lambda i: md5(seed, b, p, i))[::-1] for p, ids in pools.items()}
        got, turn = 0, 1
        while got < base + (b in plus) and pools:
            for p in sorted(pools, key=lambda p: md5(seed, b, turn, p)):
                if got == base + (b in plus):
                    break
                got += 1
                out.add((pools[p].pop(), got))
                if not pools[p]:
                    del pools[p]
            turn += 1
    return out


def test_sample_is_that_of_turns_on_any_partitioning(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(b) if b < 5 else None, int(rng.integers(0, 4)) if i % 9 else 9) for i, b in enumerate(rng.integers(0, 6, 900))] + [(10_000 + i, 5, 0) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, bucket int, period int")
    for n, seed in ((100, 1), (61, 2), (5, 3)):
        want = plain(rows, n, seed, 6)
        for x in (df.repartition(1), df.repartition(7)):
            sample = sampling.stratified(x, n, "bucket", "period", "id", seed, 6)
            assert {(r.id, r.turn) for r in sample.collect()} == want
        short = {r.bucket: r.short for r in sampling.shortfalls(sample, n, "bucket", seed, 6).collect()}
        assert short.keys() <= {5} and (n < 18 or short[5] in (n // 6 - 3, n // 6 - 2))
    assert sampling.stratified(df.limit(0), 10, "bucket", "period", "id").collect() == []


def test_group_limit_goes_ahead_of_the_exchange(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).cast("int").alias("bucket"), F.lit(0).alias("period"))
    plan = sampling.stratified(df, 9, "bucket", "period", "id", 0, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_hour_buckets(spark):
    got = [r.b for r in spark.range(24).select(sampling.hour_bucket(F.col("id")).alias("b")).collect()]
    assert got == [0, 1, 2, 2, 2, 2, *range(3, 21)]


def test_wavelet_steps_are_periodised_filters(spark):
    """Each step is a circular convolution with the reversed filter, every second value kept; the map keeps energy."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 36)
    r = np.sqrt(3)
    low = np.array([1 + r, 3 + r, 3 - r, 1 - r]) / (4 * np.sqrt(2))
    backward, high = low[::-1], np.array([-1, 1, -1, 1]) * low  # as filters are applied in time: y[o] = sum f[j] x[2 o + 2 - j]
    step = lambda v, f: np.array([sum(f[j] * v[(2 * o + 2 - j) % len(v)] for j in range(4)) for o in range(len(v) // 2)])
    one = step(x, backward)
    want = np.concatenate([step(one, backward), step(one, high), step(x, high)])
    m = shaping.wavelet_matrix(36)
    assert np.allclose(m @ x, want) and np.allclose(m @ m.T, np.eye(36))
    names = shaping.wavelet_names(36)
    assert len(names) == 36 and names[0] == "dwt_a_0" and names[9] == "dwt_d2_0" and names[18] == "dwt_d1_0"
    grid = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([*x, 3.0])], "route string, bin long, y double")
    got = {r.bin: r for r in shaping.wavelet_features(grid).collect()}
    assert sorted(got) == [35, 36]
    assert np.isclose(got[35].dwt_mean, x.mean()) and np.isclose(got[35].dwt_std, x.std()) and np.allclose(got[35].coefficients, m @ ((x - x.mean()) / x.std()))
