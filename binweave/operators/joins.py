"""Key-checked joins, comparisons of two sources, anti-joins for resuming, and table upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """df, or an error if a key occurs twice."""
    if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{what}: duplicate keys in {keys}")
    return df


def aligned(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of two row sets whose keys must be unique and the same; an error tells how many are missing on either side."""
    both = require_unique(a, keys, "left").withColumn("_a", F.lit(1)).join(require_unique(b, keys, "right").withColumn("_b", F.lit(1)), keys, "full")
    lost = both.agg(F.count_if(F.col("_b").isNull()).alias("left"), F.count_if(F.col("_a").isNull()).alias("right")).first()
    if lost.left or lost.right:
        raise ValueError(f"keys differ: {lost.left} only left, {lost.right} only right")
    return both.drop("_a", "_b")


def with_predictions(base: DataFrame, predictions: dict[str, DataFrame], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """base with one column per candidate; a row that any candidate lacks is dropped for all. Second: how many rows each lacks."""
    out = base
    for name, p in predictions.items():
        out = out.join(require_unique(p, keys, name).select(*keys, F.col("predicted").alias(name)), keys, "left")
    missing = out.agg(*(F.count_if(F.col(n).isNull()).alias(n) for n in predictions))
    return out.filter(reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in predictions), F.lit(True))), missing


def compared(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two providers' (keys, y): rounded values, difference and ratio."""
    return a.select(*keys, F.col("y").alias("a")).join(b.select(*keys, F.col("y").alias("b")), keys, "full").select(
        *keys, F.round("a").cast("long").alias("a_round"), F.round("b").cast("long").alias("b_round"), (F.col("b") - F.col("a")).alias("difference"), F.try_divide("b", "a").alias("ratio")
    )


def largest_difference(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per column the largest absolute difference over common keys: both null is 0, one null is infinite."""
    j = a.alias("a").join(b.alias("b"), keys)
    diff = lambda c: F.when(F.col(f"a.{c}").isNull() & F.col(f"b.{c}").isNull(), 0.0).when(F.col(f"a.{c}").isNull() | F.col(f"b.{c}").isNull(), float("inf")).otherwise(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")))
    return j.agg(*(F.max(diff(c)).alias(c) for c in columns))


def not_yet(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to do."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def upserted(table: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows of source in place of those of equal key, or added."""
    return table.join(source, keys, "left_anti").unionByName(source.select(*table.columns))


def latest_revision(df: DataFrame, keys: list[str], revision: str, position: str) -> DataFrame:
    """The row of the largest revision of each key; of equal ones the later by position."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(revision, position)).alias("_r")).select(*keys, "_r.*")


def shifted_lookups(base: DataFrame, values: DataFrame, key: str, offsets: dict[str, int]) -> DataFrame:
    """base with the value at bin + offset for each name, by equi joins; lags.at_offset needs none where base is the grid itself."""
    for name, k in offsets.items():
        base = base.join(values.select(key, (F.col("bin") - k).alias("bin"), F.col("y").alias(name)), [key, "bin"], "left")
    return base


def coalesced(*columns: tuple[str, Column]) -> tuple[Column, Column]:
    """The first non-null of named columns, and the name it came from."""
    value = F.coalesce(*(c for _, c in columns))
    return value, F.coalesce(*(F.when(c.isNotNull(), F.lit(n)) for n, c in columns))


def pooled(a: DataFrame, b: DataFrame, keys: list[str], label: str, tolerance: float = 1e-6) -> DataFrame:
    """Inner join of two candidates' rows, one to one; an error if their labels differ by more than the tolerance."""
    both = require_unique(a, keys, "left").join(require_unique(b, keys, "right").withColumnRenamed(label, "_label"), keys)
    apart = F.coalesce(F.abs(F.col(label) - F.col("_label")) > tolerance, F.col(label).isNull() != F.col("_label").isNull())
    if n := both.filter(apart).count():
        raise ValueError(f"labels differ in {n} rows")
    return both.drop("_label")


def either(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two feeds, under the key of whichever is there."""
    return a.join(b, keys, "full")


def attached(rows: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of another feed at the same key, null where it has none."""
    return rows.join(require_unique(values, keys, "attached"), keys, "left")


def transplanted(features: DataFrame, labels: DataFrame, keys: list[str], label: str) -> DataFrame:
    """features under another feed's label in place of their own."""
    return features.drop(label).join(require_unique(labels.select(*keys, label), keys, "labels"), keys, "left")
