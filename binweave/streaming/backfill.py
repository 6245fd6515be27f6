"""Backfills: what is still to do within a budget, states of days, shares of parallel tasks, and when to stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import not_yet


def plan(todo: DataFrame, done: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """The first `budget` keys not done yet, numbered in order."""
    first = not_yet(todo.select(*keys).distinct(), done, keys).orderBy(*keys).limit(budget)
    return first.withColumn("k", F.row_number().over(Window.orderBy(*keys)).cast("long"))  # budget rows at most


def day_states(days: DataFrame, today: int) -> DataFrame:
    """state of each day (pages fetched, failed, present before): skipped_today, failed, partial, no_data, skipped or fetched."""
    p, f = F.col("pages"), F.col("failed")
    return days.withColumn("state", F.when(F.col("day") == today, "skipped_today").when(f > p, F.when(p > 0, "partial").otherwise("failed")).when(p == 0, "no_data").when(F.col("present"), "skipped").otherwise("fetched"))


def task_share(todo: DataFrame, order: list[str], index: int, count: int) -> DataFrame:
    """Every count-th row in order from number `index` on: one task's share.

    Rows are numbered without a global sort: range partitions in order, their sizes before them, and their place within.
    """
    if not 0 <= index < count:
        raise ValueError(f"no task {index} of {count}")
    ranged = todo.repartitionByRange(int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_p", F.spark_partition_id())
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))  # one row per partition
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    own = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order))).join(F.broadcast(before), "_p")
    return own.filter((F.col("_b") + F.col("_r") - 1) % count == index).drop("_p", "_r", "_b")


def run(keys: list, score: Callable[[object], str], dry_run: bool = True, most_failures: int = 5) -> list[tuple[object, str]]:
    """(key, outcome) of a planned batch; nothing is called in a dry run; stops at a quota outcome or after failures in a row. keys is a budget's list."""
    out: list[tuple[object, str]] = []
    failures = 0
    for k in keys:
        if dry_run:
            out.append((k, "planned"))
            continue
        try:
            outcome = score(k)
        except Exception as e:  # an outside call: any failure is an outcome
            outcome = f"error: {e}"
        out.append((k, outcome))
        failures = failures + 1 if outcome.startswith("error") else 0
        if outcome == "quota" or failures >= most_failures:
            break
    return out
