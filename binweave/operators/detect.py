"""Detection post-processing: IoU, overlap suppression, greedy matching, dividing lines, counts and average precision.

Boxes are rows (id, frame, cls, x, y, w, h, confidence) with x, y the centre. What is
greedy by nature needs a frame's boxes together: rows are dealt and sorted by frame, and
each task walks through its frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _overlap(a: str, b: str) -> Column:
    edge = lambda p, c, s, sign: F.col(f"{p}.{c}") + sign * F.col(f"{p}.{s}") / 2
    side = lambda c, s: F.greatest(F.lit(0.0), F.least(edge(a, c, s, 1), edge(b, c, s, 1)) - F.greatest(edge(a, c, s, -1), edge(b, c, s, -1)))
    return side("x", "w") * side("y", "h")


def iou(a: str = "a", b: str = "b") -> Column:
    """Intersection over union of two aliased box rows."""
    inter = _overlap(a, b)
    total = F.col(f"{a}.w") * F.col(f"{a}.h") + F.col(f"{b}.w") * F.col(f"{b}.h") - inter
    return F.when(total > 0, inter / total).otherwise(0.0)


def _pair(p: tuple, q: tuple) -> float:
    inter = max(0.0, min(p[0] + p[2] / 2, q[0] + q[2] / 2) - max(p[0] - p[2] / 2, q[0] - q[2] / 2)) * max(0.0, min(p[1] + p[3] / 2, q[1] + q[3] / 2) - max(p[1] - p[3] / 2, q[1] - q[3] / 2))
    return inter


def _frames(rows: DataFrame, keys: list[str], each, schema: str, order: tuple[Column, ...] = ()) -> DataFrame:
    """Rows dealt and sorted by keys, then by the order (confidence if none is given) and id; each(list of one key's rows as tuples) -> list of result tuples."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in schema.split(", ")]
        own: list[tuple] = []
        for b in batches:
            out: list[tuple] = []
            for r in zip(*(b[c].tolist() for c in b.columns), strict=True):
                if own and own[0][: len(keys)] != r[: len(keys)]:
                    out += each(own)
                    own = []
                own.append(r)
            if out:
                yield pd.DataFrame(out, columns=names)
        if own and (out := each(own)):
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *(order or (F.desc_nulls_first("confidence"),)), "id").mapInPandas(walk, schema)


def suppressed(boxes: DataFrame, limit: float = 0.7, by_class: bool = True, smaller: bool = False, size_ratio: float = 3.0, most: int | None = 300, order_by: str = "confidence") -> DataFrame:
    """Greedy suppression by confidence, or by size (the largest box first); ties by the other, then by id.

    By IoU within a class, `most` boxes a frame; or (smaller) by the share of the smaller box, of boxes whose sizes differ by less than size_ratio,
    any number: boxes without geometry stay then, and suppress none.
    """
    if order_by not in ("confidence", "size"):
        raise ValueError(order_by)
    area = F.col("w") * F.col("h")
    by = (F.desc_nulls_first("confidence"), *((area.desc(),) if smaller else ()))
    order = by if order_by == "confidence" else (area.desc(), F.desc_nulls_first("confidence"))
    most = None if smaller else most

    def keep(rows: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        for row in rows:
            if len(kept) == most:
                break
            if smaller and any(v is None or v != v for v in row[4:8]):
                kept.append(row)
                continue
            r, a = row[4:8], row[6] * row[7]
            for k in kept:
                if smaller and any(v is None or v != v for v in k[4:8]):
                    continue
                if by_class and k[3] != row[3]:
                    continue
                inter, b = _pair(r, k[4:8]), k[6] * k[7]
                share = inter / max(1e-12, min(a, b)) if smaller else inter / max(1e-12, a + b - inter)
                if share > limit and (not smaller or max(a, b) < size_ratio * min(a, b)):
                    break
            else:
                kept.append(row)
        return kept

    return _frames(boxes.select("frame", "id", "confidence", "cls", "x", "y", "w", "h"), ["frame"], keep, "frame long, id long, confidence double, cls string, x double, y double, w double, h double", order)


def directed(boxes: DataFrame, line: list[tuple[float, float]]) -> DataFrame:
    """direction of each box: its foot point above the polyline (ascending x) or not; Unknown beyond its ends."""
    if any(a[0] >= b[0] for a, b in zip(line, line[1:], strict=False)):
        raise ValueError("the line's x must ascend")
    foot, y = F.col("y") + F.col("h") / 2, F.lit(None).cast("double")
    for (x0, y0), (x1, y1) in zip(line, line[1:], strict=False):
        y = F.when(F.col("x").between(x0, x1), y0 + (F.col("x") - x0) * (y1 - y0) / (x1 - x0)).otherwise(y)
    return boxes.withColumn("direction", F.when(y.isNull(), "Unknown").when(foot < y, "A").otherwise("B"))


def frame_counts(boxes: DataFrame) -> DataFrame:
    """Counts per frame by direction, which add up to the total, with level and vertical extent."""
    count = lambda d: F.count_if(F.col("direction") == d)
    out = boxes.groupBy("frame").agg(F.count("*").alias("total"), count("A").alias("a"), count("B").alias("b"), count("Unknown").alias("unknown"), F.round(F.max(F.col("y") + F.col("h") / 2) - F.min(F.col("y") - F.col("h") / 2), 4).alias("extent"))
    return out.withColumn("level", F.when(F.col("total") < 20, "low").when(F.col("total") < 40, "moderate").when(F.col("total") < 71, "high").otherwise("severe"))


def count_errors(boxes: DataFrame, directions: list[str]) -> DataFrame:
    """boxes(frame, direction, predicted, true): predicted less true boxes of each frame and direction."""
    diff = lambda d: (F.count_if((F.col("direction") == d) & F.col("predicted")) - F.count_if((F.col("direction") == d) & F.col("true"))).alias(f"{d.lower()}_error")
    return boxes.groupBy("frame").agg(*(diff(d) for d in directions))


def _matches(truth: DataFrame, predictions: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(frame, cls, id, confidence, hits): bit i of hits tells whether the prediction is matched at threshold i. One walk serves all thresholds; each keeps its own free boxes."""
    if len(thresholds) > 63:
        raise ValueError("at most 63 thresholds")
    box, least = ["x", "y", "w", "h"], min(thresholds)
    key = F.coalesce(F.col("id").cast("long"), F.lit(-(2**63))) if "id" in truth.columns else F.lit(0).cast("long")
    t = truth.select("frame", "cls", F.lit(True).alias("truth"), F.lit(None).cast("double").alias("confidence"), key.alias("id"), *box)
    p = predictions.select("frame", "cls", F.lit(False).alias("truth"), F.col("confidence").cast("double"), F.col("id").cast("long"), *box)

    def match(rows: list[tuple]) -> list[tuple]:
        truths = sorted((r[4:] for r in rows if r[2]), key=lambda g: (g[0], *(v if v == v else 0.0 for v in g[1:])))
        free = [[True] * len(truths) for _ in thresholds]
        out = []
        for frame, cls, _, confidence, id_, *r in (r for r in rows if not r[2]):
            hits = 0
            if truths:
                shares = ((_pair(r, g) / max(1e-12, r[2] * r[3] + g[2] * g[3] - _pair(r, g)), i) for i, (_, *g) in enumerate(truths))
                near = sorted((s for s in shares if s[0] >= least), reverse=True)
                for k, threshold in enumerate(thresholds) if near else ():
                    best = next((s for s in near if free[k][s[1]]), None)
                    if best and best[0] >= threshold:
                        free[k][best[1]] = False
                        hits |= 1 << k
            out.append((frame, cls, id_, confidence, hits))
        return out

    return _frames(t.unionAll(p), ["frame", "cls"], match, "frame long, cls string, id long, confidence double, hits long")


def matched(truth: DataFrame, predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """predictions with hit: greedy one-to-one matching within frame and class, by confidence, each to its best free box, of equally good ones to that of the largest id."""
    return _matches(truth, predictions, (threshold,)).select("frame", "cls", "id", "confidence", (F.col("hits") == 1).alias("hit"))


def coco_precision(truth: DataFrame, predictions: DataFrame, overlaps: tuple[float, ...] = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)) -> DataFrame:
    """Per class the average precision at overlap 0.5 and the mean over all overlaps; each overlap has a matching of its own, all in one walk."""
    hit = lambda i: F.count_if(F.col("hits").bitwiseAND(1 << i) != 0)
    sums = _matches(truth, predictions, overlaps).groupBy("cls", "confidence").agg(F.count("*").alias("n"), F.array(*(F.struct(F.lit(t).alias("overlap"), hit(i).alias("t")) for i, t in enumerate(overlaps))).alias("_o"))
    steps = sums.select("cls", "confidence", "n", F.inline("_o"))
    total = truth.groupBy("cls").agg(F.count("*").alias("total")).withColumn("overlap", F.explode(F.array(*map(F.lit, overlaps))))
    out = _precision(steps, total, ["cls", "overlap"])
    return out.groupBy("cls").agg(F.max(F.when(F.col("overlap") == 0.5, F.col("ap"))).alias("ap_50"), F.avg("ap").alias("ap"))


def average_precision(matches: DataFrame, truths: DataFrame) -> DataFrame:
    """Per class the mean over 101 recalls of the best precision at that recall or beyond.

    The running counts need each class in order of confidence; rows are (class, confidence) sums first, so ties share a step.
    """
    steps = matches.groupBy("cls", "confidence").agg(F.count_if("hit").alias("t"), F.count("*").alias("n"))
    return _precision(steps, truths.groupBy("cls").agg(F.count("*").alias("total")), ["cls"])


def _precision(steps: DataFrame, total: DataFrame, keys: list[str]) -> DataFrame:
    """Average precision per keys of steps(keys, confidence, t hits of n) and total(keys, total)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, 0)
    curve = steps.withColumns({"tp": F.sum("t").over(w), "k": F.sum("n").over(w)}).join(total, keys).select(*keys, (F.col("tp") / F.col("total")).alias("recall"), (F.col("tp") / F.col("k")).alias("precision"))
    at = curve.withColumn("r", F.explode(F.sequence(F.lit(0), F.floor(F.col("recall") * 100 + 1e-9).cast("int")))).groupBy(*keys, "r").agg(F.max("precision").alias("p"))
    return total.select(*keys).join(at.groupBy(*keys).agg(F.sum("p").alias("s")), keys, "left").select(*keys, (F.coalesce("s", F.lit(0.0)) / 101).alias("ap"))


def rescaled(line: list[tuple[float, float]], own: tuple[float, float], to: tuple[float, float]) -> list[tuple[float, float]]:
    """A polyline drawn on a picture of one size, for frames of another."""
    return [(x * to[0] / own[0], y * to[1] / own[1]) for x, y in line]


def decoded(rows: DataFrame, floor: float, most: int = 30_000, scores: str = "scores") -> DataFrame:
    """rows(frame, anchor, scores array) -> the class of the largest score (of equal ones the first), where it reaches the floor; of a frame the `most` best."""
    best = F.array_max(scores)
    own = rows.withColumn("score", best).filter(F.col("score") >= floor).withColumn("cls", F.array_position(scores, F.col("score")) - 1)
    w = Window.partitionBy("frame").orderBy(F.desc("score"), "anchor")
    return own.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n", scores)


def frame_plan(frames: DataFrame, camera: str, stamp: str, name: str, first_s: int, end_s: int) -> tuple[DataFrame, DataFrame]:
    """The frames of a window, one per camera and capture time (the first by name), and the names without a time."""
    there = frames.filter((F.col(stamp) >= first_s) & (F.col(stamp) < end_s))
    return there.groupBy(camera, stamp).agg(F.min(name).alias(name)), frames.filter(F.col(stamp).isNull()).select(name)
