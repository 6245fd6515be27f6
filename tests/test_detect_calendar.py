"""Overlap suppression by size, boxes without geometry, flagged days ahead, equivalence."""

import random

from binweave.operators import comparison, detect, shaping
from pyspark.sql import functions as F

BOX = "frame long, id long, cls string, x double, y double, w double, h double, confidence double"


def share(a, b):
    inter = max(0, min(a[3] + a[5] / 2, b[3] + b[5] / 2) - max(a[3] - a[5] / 2, b[3] - b[5] / 2)) * max(0, min(a[4] + a[6] / 2, b[4] + b[6] / 2) - max(a[4] - a[6] / 2, b[4] - b[6] / 2))
    return inter / min(a[5] * a[6], b[5] * b[6])


def plain(rows, by):
    out = set()
    for frame in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == frame]
        out |= {r[1] for r in own if None in r[3:7]}
        area = lambda r: r[5] * r[6]
        kept = []
        for r in sorted((r for r in own if None not in r[3:7]), key=lambda r: (-area(r), -r[7], r[1]) if by == "size" else (-r[7], -area(r), r[1])):
            if not any(share(r, k) > 0.6 and max(area(r), area(k)) < 3 * min(area(r), area(k)) for k in kept):
                kept.append(r)
        out |= {r[1] for r in kept}
    return out


def test_suppression_by_either_order(spark):
    rng = random.Random(3)
    rows = [(f, f * 1000 + i, "c", rng.uniform(0, 30), rng.uniform(0, 30), float(rng.choice([8, 10, 14])), float(rng.choice([8, 10, 14])), round(rng.random(), 1)) for f in range(4) for i in range(400 if f == 0 else 30)]
    rows += [(1, 9001, "c", None, 1.0, 2.0, 2.0, 0.9), (1, 9002, "c", None, None, None, None, 0.1)]
    df = spark.createDataFrame(rows, BOX).repartition(3)
    kept = {}
    for by in ("confidence", "size"):
        kept[by] = {r.id for r in detect.suppressed(df, 0.6, by_class=False, smaller=True, order_by=by).collect()}
        assert kept[by] == plain(rows, by)
    assert kept["confidence"] != kept["size"]
    wide = spark.createDataFrame([(1, i, "c", 100.0 * i, 0.0, 2.0, 2.0, 0.5) for i in range(350)], BOX)
    assert detect.suppressed(wide, 0.6, by_class=False, smaller=True).count() == 350  # no cap on what doesn't overlap
    assert detect.suppressed(wide).count() == 300


def test_flagged_days(spark):
    rng = random.Random(5)
    days = [(k, d, rng.random() < 0.15) for k in ("a", "b", None) for d in range(100) if rng.random() < 0.9]
    flags = {(k, d) for k, d, on in days if on}
    got = {(r.k, r.day): (r.first, r.last, r.next, r.in_days) for r in shaping.flagged_runs(spark.createDataFrame(days, "k string, day long, f boolean"), "k", "day", F.col("f")).collect()}
    assert len(got) == len(days)
    for k, d, on in days:
        if on:
            a = b = d
            while (k, a - 1) in flags:
                a -= 1
            while (k, b + 1) in flags:
                b += 1
            assert got[k, d] == (a, b, None, None)
        else:
            n = next((d + i for i in range(1, 22) if (k, d + i) in flags), None)
            assert got[k, d] == (None, None, n, n and n - d)


def test_equivalence(spark):
    rng = random.Random(1)
    rows = [("near", d, 20.0, 20.0 + rng.gauss(0, 0.2), 20.0 + rng.gauss(0, 0.2)) for d in range(20) for _ in range(10)] + [("far", d, 20.0, 22.0 + rng.random(), 20.1) for d in range(20) for _ in range(10)]
    df = spark.createDataFrame(rows, "k string, day long, y double, a double, b double")
    got = {r.k: r for r in comparison.equivalent(df, ["k"], "day", "y", "a", "b", draws=300).collect()}
    assert got["near"].equivalent and not got["far"].equivalent and got["far"].low > 0.5


def test_equally_good_boxes_are_taken_by_id(spark):
    """A prediction between two boxes takes that of the larger id, whatever the order of rows; what the next one finds depends on it."""
    from binweave.operators import detect

    schema = "id long, frame long, cls string, x double, y double, w double, h double, confidence double"
    left, right = (0.0, 0.0, 10.0, 10.0, 0.0), (4.0, 0.0, 10.0, 10.0, 0.0)
    found = spark.createDataFrame([(-7, 1, "car", 2.0, 0.0, 10.0, 10.0, 0.9), (8, 1, "car", 0.5, 0.0, 10.0, 10.0, 0.5)], schema)
    for a, b, second in ((2, 4, True), (4, 2, False)):
        rows = [(a, 1, "car", *left), (b, 1, "car", *right)]
        for truth in (rows, rows[::-1]):
            got = {r.id: r.hit for r in detect.matched(spark.createDataFrame(truth, schema).coalesce(1), found, 0.5).collect()}
            assert got == {-7: True, 8: second}


def test_all_overlaps_are_matched_in_one_walk(spark):
    """coco_precision reads and deals the boxes once for all ten overlaps."""
    from binweave.operators import detect

    b = spark.createDataFrame([(i, i % 3, "car", float(i), 0.0, 10.0, 10.0, i / 9) for i in range(9)], "id long, frame long, cls string, x double, y double, w double, h double, confidence double")
    plan = detect.coco_precision(b, b)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_exported_files_are_several_and_in_order(spark):
    """An export is written by several tasks; its files, by name, go on in order."""
    from binweave.plans.sink_queries import _csv
    from binweave.sources.readers import file_order
    from pyspark.sql import functions as F

    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        path = _csv(spark.range(999, -1, -1).select("id", F.col("id").alias("k")), "k", "t")
    finally:
        spark.conf.set(key, before)
    got = spark.read.schema("id long").option("header", True).csv(path).select("id", file_order().alias("at"))
    assert got.select("at.file").distinct().count() > 1
    assert [r.id for r in got.orderBy("at").collect()] == list(range(1000))
