"""Regular time bins of irregular observations, gaps between them, dense grids and bounded forward fill.

A bin is named by `bin`, its number: seconds since the epoch over the width. Observations
are aggregated to bins first; windows then run over bins, of which a series has a number
that its time span bounds, however many observations it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import SeriesSpec

SPEC = SeriesSpec()


def seconds(ts: Column | str) -> Column:
    return F.unix_seconds((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def bin_of(ts: Column | str, width_s: int = SPEC.width_s) -> Column:
    return F.floor(seconds(ts) / width_s).cast("long")


def valid(df: DataFrame, status: str | None = None, value: str = "value") -> DataFrame:
    """Observations with a value and, where there is a status column, status OK."""
    out = df.filter(F.col(value).isNotNull())
    return out.filter(F.col(status) == "OK") if status else out


def not_carried(df: DataFrame, message: str = "error_message") -> DataFrame:
    """Without rows that a carry-forward wrote."""
    return df.filter(~F.coalesce(F.col(message), F.lit("")).startswith("carried_forward"))


def binned(df: DataFrame, spec: SeriesSpec = SPEC, keys: list[str] | None = None) -> DataFrame:
    """Mean and count of each series and bin: (keys, bin, y, n)."""
    return valid(df, value=spec.value).groupBy(*(keys or [spec.key]), bin_of(spec.ts, spec.width_s).alias("bin")).agg(F.avg(spec.value).alias("y"), F.count("*").alias("n"))


def ordered(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("bin")


def with_gap(bins: DataFrame, key: str = "route", width_s: int = 600) -> DataFrame:
    """gap_min: minutes since the series' previous bin, null for the first."""
    return bins.withColumn("gap_min", (F.col("bin") - F.lag("bin").over(ordered(key))) * (width_s // 60))


def with_after_gap(bins: DataFrame, key: str = "route", gap_min: int = 25, rows: int = 6, cut: bool = False) -> DataFrame:
    """after_gap: 1 if a gap above gap_min lies within this row and the `rows` before; cut: the first row follows one, too."""
    first = F.lit(1 if cut else 0)
    gap = F.when(F.col("gap_min").isNull(), first).otherwise((F.col("gap_min") > gap_min).cast("int"))
    return bins.withColumn("after_gap", F.max(gap).over(ordered(key).rowsBetween(-rows, 0)).cast("long"))


def dense(bins: DataFrame, key: str = "route", first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Every bin from each series' first to last (or between the given ones), y null where there is none."""
    span = bins.groupBy(key).agg((F.min("bin") if first is None else first).alias("a"), (F.max("bin") if last is None else last).alias("b"))
    return span.select(key, F.explode(F.sequence("a", "b")).alias("bin")).join(bins, [key, "bin"], "left")


def filled(grid: DataFrame, limit: int | None, key: str = "route", column: str = "y", to: str = "y_filled") -> DataFrame:
    """Forward fill over at most `limit` bins of a dense grid (None: without bound, 0: not at all)."""
    w = ordered(key).rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return grid.withColumn(to, F.last(column, ignorenulls=True).over(w))


def last_segment(grid: DataFrame, key: str = "route", column: str = "y_filled", least: int = 1) -> DataFrame:
    """The rows after each series' last null, if its newest row isn't null and there are at least `least`."""
    w = Window.partitionBy(key)
    hole = F.max(F.when(F.col(column).isNull(), F.col("bin"))).over(w)
    kept = grid.withColumn("_hole", hole).withColumn("_end", F.max("bin").over(w)).filter((F.col("bin") > F.coalesce("_hole", F.lit(-1))) & (F.coalesce("_hole", F.lit(-1)) < F.col("_end")))
    return kept.withColumn("_n", F.count("*").over(w)).filter(F.col("_n") >= least).drop("_hole", "_end", "_n")
