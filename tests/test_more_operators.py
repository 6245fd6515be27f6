"""Rules, guards, comparisons, models, readers and sinks beyond what the SQL oracles show."""

import json
import math
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from binweave.operators import comparison, detect, fuzzy, horizons, joins, metrics, models, stacks, rows, serving, significance


def test_guards(spark):
    assert rows.window_end(10_000) == 7_200 and rows.window_end(10_000, 6_600) == 6_600
    with pytest.raises(ValueError):
        rows.window_end(10_000, 7_800)
    rows.check_protected(0, 10, (10, 20))
    with pytest.raises(ValueError):
        rows.check_protected(5, 11, (10, 20))
    with pytest.raises(ValueError):
        rows.required_out_of_sample(100, 100)
    with pytest.raises(ValueError):
        rows.strict_route(spark.range(1), "a")
    assert rows.day_window(None, None, "2024-03-08") == ("2024-03-01", "2024-03-07")
    for a, b in ((None, "2024-03-09"), ("2024-03-05", "2024-03-04")):
        with pytest.raises(ValueError):
            rows.day_window(a, b, "2024-03-08")
    assert rows.read_window(1_000_000, 2_000_000, look_back_s=500_000, history_s=1_600_000) == (1_600_000 - 604_800, 2_002_400)
    for minutes in (5, 15, 1450):
        with pytest.raises(ValueError):
            horizons.check_horizon(minutes)
    with pytest.raises(ValueError):
        serving.require_no_duplicates(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])
    ok = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "g string, t int")
    assert serving.contiguous(ok, "g", "t").count() == 3
    for bad in ([("a", 1), ("a", 6), ("b", 5)], [("a", 1), ("a", 1)]):
        with pytest.raises(ValueError):
            serving.contiguous(spark.createDataFrame(bad, "g string, t int"), "g", "t")


def test_pooled_labels_must_agree(spark):
    a = spark.createDataFrame([(1, 2.0, 5.0), (2, 3.0, 6.0)], "k int, y double, p double")
    b = spark.createDataFrame([(1, 2.0, 7.0), (3, 3.0, 8.0)], "k int, y double, q double")
    assert [tuple(r) for r in joins.pooled(a, b, ["k"], "y").collect()] == [(1, 2.0, 5.0, 7.0)]
    with pytest.raises(ValueError):
        joins.pooled(a, b.withColumn("y", F.col("y") + 0.1), ["k"], "y")


def test_slice_scores_keep_null_keys(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 2.0), (None, "x", 1.0, 4.0), ("a", None, 1.0, 6.0)], "route string, period string, actual double, m double")
    got = sorted((str(r.route), r.slice, r.n, r.mae) for r in metrics.slice_scores(df, "route", ["period"], ["m"]).collect())
    assert got == sorted([("both", "all", 3, 3.0), ("both", "period=x", 2, 2.0), ("both", "period", 1, 5.0), ("a", "all", 2, 3.0), ("a", "period=x", 1, 1.0), ("a", "period", 1, 5.0), ("None", "all", 1, 3.0), ("None", "period=x", 1, 3.0)])


def test_small_sample_factor():
    """Where the factor isn't positive the statistic goes uncorrected."""
    stat, low, _ = significance.diebold_mariano(1.0, 0.25, 4, 4)
    assert (4 + 1 - 8 + 12 / 4) / 4 == 0 and stat == 2.0 and 0.5 < low < 1


def test_correlation_p_values():
    assert math.isclose(significance.pearson_p(0.5, 27), 0.00790, abs_tol=1e-4)
    assert math.isclose(significance.normal_p(1.959964), 0.05, abs_tol=1e-6)
    assert math.isclose(significance.t_p(2.085963, 20), 0.05, abs_tol=1e-6)


def test_comparisons(spark):
    """A clear difference over enough days is decided, over too few it isn't; draws depend on nothing but the seed and the keys."""
    data = [(f"r{g}", day, 10.0, 10.0 + (0.5 if g else 3.0) + 0.01 * i, 12.0) for g in (0, 1) for day in range(12 if g else 4) for i in range(5)]
    df = spark.createDataFrame(data, "route string, day int, y double, a double, b double")
    got = {r.route: r for r in comparison.compare(df, ["route"], "day", "y", "a", "b", draws=200).collect()}
    assert got["r1"].decision == "candidate" and got["r0"].decision == "inconclusive" and got["r0"].low > 0
    again = {r.route: r for r in comparison.compare(df.repartition(7), ["route"], "day", "y", "a", "b", draws=200).collect()}
    assert all(math.isclose(got[k].low, again[k].low, rel_tol=1e-9) for k in got)
    assert {r.verdict for r in comparison.substitution(spark.createDataFrame([(-0.2, 0.3), (0.6, 1.0), (-3.0, -1.0), (-1.0, 1.0)], "low double, high double")).collect()} == {"substitute", "regression", "improvement", "inconclusive"}


def test_rolling_ridge_equals_refits(spark):
    rng = np.random.default_rng(0)
    data = [("a", d * 144 - 48 + i * 12, d, float(rng.normal()), float(rng.normal())) for d in range(19000, 19006) for i in range(12)]
    data = [(r, b, (b * 600 + 28800) // 86400, x, 2 * x + y) for r, b, _, x, y in data]
    df = spark.createDataFrame(data, "route string, bin long, local_day long, x double, y double")
    got = {r.bin: r.ridge for r in horizons.rolling_ridge(df, ["x"], "y", "route", least=10).collect()}
    for _, b, day, x, _ in data:
        past = [(v[3], v[4]) for v in data if v[1] * 600 + 2400 + 28800 <= day * 86400]
        if len(past) < 10:
            assert got[b] is None
            continue
        p, q = np.array(past).T
        w = ((p - p.mean()) / p.std() @ (q - q.mean())) / (len(p) + 1) / p.std()
        assert math.isclose(got[b], q.mean() + w * (x - p.mean()), rel_tol=1e-9)


def test_ablation_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    y = x @ [1.0, -2.0] + rng.normal(0, 0.1, 60)
    df = spark.createDataFrame([("a", "test" if i >= 40 else "train", float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "route string, part string, p double, q double, y double")
    got = {r.features: r.mae for r in horizons.ablation(df, {"A": ["p"], "B": ["p", "q"]}, "y", "route").collect()}
    for name, own in (("A", [0]), ("B", [0, 1])):
        t, m = x[:40][:, own], x[:40][:, own].mean(axis=0)
        s = t.std(axis=0)
        w = np.linalg.solve(((t - m) / s).T @ ((t - m) / s) + np.eye(len(own)), ((t - m) / s).T @ (y[:40] - y[:40].mean())) / s
        assert math.isclose(got[name], np.abs(y[:40].mean() + (x[40:][:, own] - m) @ w - y[40:]).mean(), rel_tol=1e-9)


def test_pair_stack_is_the_best_weight(spark):
    rng = np.random.default_rng(2)
    data = [("a", d, float(p), float(q), float(0.7 * p + 0.3 * q + rng.normal(0, 0.2))) for d in range(5) for p, q in rng.normal(20, 5, (20, 2))]
    df = spark.createDataFrame(data, "route string, local_day long, p double, q double, y double")
    got = {(r.local_day, r.p): r.stack for r in fuzzy.pair_stack(df, "p", "q", "y", "route", "local_day").collect()}
    for day in range(5):
        past = np.array([v[2:] for v in data if v[1] < day])
        own = [v for v in data if v[1] == day]
        w = (got[(day, own[0][2])] - own[0][3]) / (own[0][2] - own[0][3])
        if day < 2:
            assert math.isclose(w, 0.5, abs_tol=1e-9)
            continue
        loss = lambda v: np.abs(past[:, 2] - v * past[:, 0] - (1 - v) * past[:, 1]).sum()  # noqa: B023, E731
        assert loss(w) <= min(loss(v) for v in np.linspace(0, 1, 2001)) + 1e-9


def test_restarts_find_the_clusters(spark):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(m, 0.3, (60, 2)) for m in (0, 5, 12)])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in points], "a double, b double")
    centres, objective = fuzzy.restarts(df, ["a", "b"], 3)
    assert np.abs(centres - np.array([[0, 0], [5, 5], [12, 12]])).max() < 0.3 and objective > 0


def test_coco_precision_against_a_plain_walk(spark):
    rng = np.random.default_rng(4)
    truth = [(int(f), "car", i, float(x), float(y), 10.0, 10.0, 0.0) for i, (f, x, y) in enumerate(zip(rng.integers(0, 6, 30), rng.uniform(0, 60, 30), rng.uniform(0, 60, 30), strict=True))]
    found = [(f, c, i, x + float(rng.normal(0, 1.5)), y + float(rng.normal(0, 1.5)), w, h, float(rng.uniform())) for f, c, i, x, y, w, h, _ in truth] + [(0, "car", 99, 200.0, 200.0, 10.0, 10.0, 0.95)]
    schema = "frame long, cls string, id long, x double, y double, w double, h double, confidence double"
    got = detect.coco_precision(spark.createDataFrame(truth, schema), spark.createDataFrame(found, schema)).first()

    def iou(p, q):
        side = lambda k, s: max(0.0, min(p[k] + p[s] / 2, q[k] + q[s] / 2) - max(p[k] - p[s] / 2, q[k] - q[s] / 2))
        inter = side(3, 5) * side(4, 6)
        return inter / (p[5] * p[6] + q[5] * q[6] - inter)

    aps = []
    for t in np.arange(0.5, 0.96, 0.05):
        free, hits = set(range(len(truth))), []
        for p in sorted(found, key=lambda p: -p[7]):
            best = max(((iou(p, truth[i]), i) for i in free if truth[i][0] == p[0]), default=(0, None))
            hits.append(best[0] >= round(float(t), 2))
            if hits[-1]:
                free.discard(best[1])
        tp = np.cumsum(hits)
        recall, precision = tp / len(truth), tp / np.arange(1, len(hits) + 1)
        aps.append(np.mean([max((p for r, p in zip(recall, precision, strict=True) if r >= x - 1e-9), default=0) for x in np.linspace(0, 1, 101)]))
    assert math.isclose(got.ap_50, aps[0], abs_tol=1e-9) and math.isclose(got.ap, np.mean(aps), abs_tol=1e-9)


def test_registry_drift(spark):
    now = F.lit(5)
    row = spark.range(1).select(*serving.registry_row(now, "mix", {"weight": F.lit(0.5)}, {"depth": 4}))
    read = lambda config: serving.registry_read(row, "mix", "weight double", config).first()
    assert read({"depth": 4}).parts.weight == 0.5 and not read({"depth": 4}).drift and read({"depth": 5}).drift and read({"depth": 4}).fallback is None


def test_rest_pages(spark, tmp_path):
    from binweave.sources import rest

    assert rest.retry_after("7") == 7 and rest.retry_after("soon") is None
    assert rest.retry_after("Wed, 21 Oct 2015 07:28:10 GMT", datetime(2015, 10, 21, 7, 28, tzinfo=timezone.utc)) == 10
    waits, calls = [], []

    def get():
        calls.append(1)
        if len(calls) == 1:
            raise rest.Failed(429, "3")
        if len(calls) == 2:
            raise rest.Failed(503)
        return "ok"

    assert rest.with_retries(get, sleep=waits.append) == "ok" and waits == [3, 2]
    with pytest.raises(rest.Failed):
        rest.with_retries(lambda: (_ for _ in ()).throw(rest.Failed(400)), sleep=waits.append)
    page = lambda token=None, code=0: json.dumps({"code": code, "data": {"paginationToken": token}})
    for name, body in (("2024-01-01-first", page("b")), ("2024-01-01-b", page()), ("2024-01-03-first", page("b")), ("2024-01-03-b", page("b")), ("2024-01-04-first", page(code=4)), ("2024-01-05-first", page("c"))):
        (tmp_path / name).write_text(body)
    got = {(r.day, r.page): r.state for r in rest.days(spark, f"file://{tmp_path}/{{day}}-{{token}}", "2024-01-01", "2024-01-05").collect()}
    assert got == {("2024-01-01", 1): "ok", ("2024-01-01", 2): "ok", ("2024-01-02", 1): "no_data", ("2024-01-03", 1): "ok", ("2024-01-03", 2): "ok", ("2024-01-03", 3): "failed", ("2024-01-04", 1): "failed", ("2024-01-05", 1): "ok", ("2024-01-05", 2): "failed"}


def test_detection_files(spark, tmp_path):
    from binweave.sources import readers

    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a"}], "annotations": [{"image_id": 1, "category_id": 2, "bbox": [10, 20, 4, 6]}], "categories": [{"id": 2, "name": "car"}]}))
    assert tuple(readers.coco(spark, str(tmp_path / "c.json")).first()) == (1, "car", 12.0, 23.0, 4.0, 6.0)
    (tmp_path / "f7.txt").write_text("2 0.5 0.25 0.1 0.2\n\n")
    assert tuple(readers.yolo(spark, str(tmp_path / "f7.txt"), 100, 40)).__len__() == 6
    assert tuple(readers.yolo(spark, str(tmp_path / "f7.txt"), 100, 40).first()) == ("f7", "2", 50.0, 10.0, 10.0, 8.0)
    (tmp_path / "p.json").write_text(json.dumps({"frame": "a", "predictions": [{"class": "car", "confidence": 0.5, "x": 1.0, "y": 2.0, "width": 3.0, "height": 4.0}]}))
    assert tuple(readers.predictions(spark, str(tmp_path / "p.json")).first()) == ("a", "car", 1.0, 2.0, 3.0, 4.0, 0.5)
    for camera, month in (("1", "2024-01"), ("1", "2024-02"), ("2", "2024-01")):
        folder = tmp_path / "frames" / f"camera_id={camera}" / f"month={month}"
        folder.mkdir(parents=True)
        (folder / "x.jpg").write_bytes(b"1")
        (folder / "x.txt").write_bytes(b"1")
    assert readers.frame_files(spark, str(tmp_path / "frames"), ["1"], ["2024-02"]).count() == 1 and readers.frame_files(spark, str(tmp_path / "frames")).count() == 3


def test_cached_table_and_csv_sinks(spark, tmp_path):
    from binweave.sources import readers, sinks

    loads = []

    def load():
        loads.append(1)
        return spark.range(len(loads))

    path = str(tmp_path / "t")
    assert [readers.cached_table(spark, path, load).count(), readers.cached_table(spark, path, load).count(), readers.cached_table(spark, path, load, refresh=True).count()] == [1, 1, 2]
    csv = str(tmp_path / "k.csv")
    put = lambda rows: sinks.upsert_csv(spark.createDataFrame(rows, "k string, v string"), csv, ["k"], "k string, v string")
    put([("b", "1"), ("a", "2")])
    put([("b", "3"), ("c", "4")])
    assert (tmp_path / "k.csv").read_text().split() == ["k,v", "a,2", "b,3", "c,4"]
    assert {r.k for r in sinks.done_keys(spark, csv, "k", "csv", "k string, v string").collect()} == {"a", "b", "c"}
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "f1.jpg").write_bytes(b"x")
    assert [r.k for r in sinks.done_keys(spark, str(tmp_path / "images"), "k", "folder").collect()] == ["f1"] and sinks.done_keys(spark, str(tmp_path / "none"), "k").count() == 0
    spark.sql(f"create database if not exists bw location '{tmp_path / 'db'}'")
    for _ in range(2):
        sinks.ensure_tables(spark, {"bw.forecasts": ("route string, y double, day date", ["day"])})
    assert spark.table("bw.forecasts").columns == ["route", "y", "day"]
    spark.sql("drop database bw cascade")


def test_run_folders(spark, tmp_path):
    from binweave.sources import runs

    root = str(tmp_path / "runs")
    folder = runs.write_run(spark, root, "v1", {"scores": spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")}, {"depth": 4})
    with pytest.raises(ValueError):
        runs.write_run(spark, root, "v1", {}, {})
    runs.promote(spark, root, "v1")
    assert runs.latest(spark, root) == "v1" and runs.validated(spark, folder)["config"] == {"depth": 4}
    runs.replay(spark, folder, {"figure": ("scores", ["k", "v"])}, str(tmp_path / "out"))
    assert (tmp_path / "out" / "figure.csv").read_text().split() == ["k,v", "1,a", "2,b"]
    with pytest.raises(ValueError):
        runs.replay(spark, folder, {}, str(tmp_path / "out" / "x"), (str(tmp_path / "out"),))
    spark.createDataFrame([(3, "c")], "k int, v string").write.mode("append").parquet(f"{folder}/scores")
    with pytest.raises(ValueError):
        runs.promote(spark, root, "v1")


def test_backfill_stops():
    from binweave.streaming.backfill import run

    def fails(k):
        raise OSError("down")

    assert [o for _, o in run([1, 2], fails)] == ["planned"] * 2
    assert len(run(list(range(9)), fails, dry_run=False)) == 5
    assert [o for _, o in run([1, 2, 3], lambda k: "quota" if k == 2 else "ok", dry_run=False)] == ["ok", "quota"]


def test_observations_frames_and_series_files(spark, tmp_path):
    from binweave.sources import readers, sinks

    (tmp_path / "o.csv").write_text("observed_at,route_id,direction,status,distance_m,duration_sec,duration_in_traffic_sec,error_message\n2026-01-01T00:00:00Z,r1,A,OK,1,2,3,\nno time,r1,A,OK,1,2,3,\n2026-01-01T00:10:00+08:00,r2,B,OK,1,2,3,carried_forward\n")
    assert {r.route_id: r.ts.timestamp() % 86400 for r in readers.observations(spark, str(tmp_path / "o.csv")).collect()} == {"r1": 0, "r2": 16 * 3600 + 600}
    assert readers.observations(spark, str(tmp_path / "o.csv"), "r2").count() == 1
    (tmp_path / "c.csv").write_text("frame_ts,status,a,b\n2026-01-01 08:00:00,ok,1,2\n2026-01-01 08:00:00,ok,3,4\n2026-01-01 08:10:00,bad,5,6\n")
    assert [(r.ts.timestamp() % 86400, r.a, r.b) for r in readers.frames(spark, str(tmp_path / "c.csv")).collect()] == [(0, 3.0, 4.0)]
    sinks.plot_series(spark.createDataFrame([(1, 1.5), (2, float("nan")), (3, float("inf"))], "k int, v double"), str(tmp_path / "s"), ["k", "v"])
    assert {(r.k, r.v) for r in spark.read.option("header", True).csv(str(tmp_path / "s")).collect()} == {("1", "1.5"), ("2", None), ("3", None)}
    df = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, x int")
    sinks.append(df, str(tmp_path / "p"), ["k", "v"], "v")
    assert sorted(spark.read.parquet(str(tmp_path / "p")).columns) == ["k", "v"] and (tmp_path / "p" / "v=a").exists()


def test_guarded_load_is_all_or_nothing(spark, tmp_path):
    from binweave.sources import sinks

    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    rows = lambda *t: spark.createDataFrame([(x,) for x in t], "t int")
    sinks.guarded_load({a: (rows(1, 2), "t"), b: (rows(1), "t")})
    with pytest.raises(ValueError):
        sinks.guarded_load({a: (rows(3), "t"), b: (rows(1), "t")})
    assert spark.read.parquet(a).count() == 2
    sinks.guarded_load({a: (rows(3), "t")}, str(tmp_path / "old"))
    assert spark.read.parquet(a).count() == 3 and spark.read.parquet(str(tmp_path / "old" / "a")).count() == 2


def test_simplex_weights_of_two_are_exact():
    rng = np.random.default_rng(5)
    for _ in range(20):
        p = rng.normal(20, 5, (25, 2))
        y = p @ [0.4, 0.6] + rng.normal(0, 2, 25)
        w = stacks.convex_weights(p, y)[0]
        grid = min(float(np.abs(v * p[:, 0] + (1 - v) * p[:, 1] - y).mean()) for v in np.linspace(0, 1, 5001))
        assert math.isclose(w.sum(), 1) and w.min() >= 0 and np.abs(p @ w - y).mean() <= grid + 1e-12
