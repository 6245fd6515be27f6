"""As-of joins and bounded look-backs.

The as-of join has no join at all: both sides are united and the last right row is
carried along in time. To keep one busy key out of one task, time is cut into buckets;
the window runs within (key, bucket), and what a bucket inherits comes from a second
window over the last row of each bucket, of which there are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, left_t: str, right_t: str, columns: list[str], tolerance: int | None = None, bucket: int = 86400) -> DataFrame:
    """left with `columns` and asof_age of the newest right row of the key at or before left_t (in seconds), null beyond the tolerance.

    Of right rows at one instant the largest by `columns` counts.
    """
    payload = F.struct(F.col(right_t).alias("t"), *columns)
    l = left.withColumn("_t", F.col(left_t)).withColumn("_side", F.lit(1)).withColumn("_row", F.struct(*left.columns))
    both = l.select(F.col(key).alias("_k"), "_t", "_side", "_row", F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_p")).unionAll(
        right.filter(F.col(right_t).isNotNull()).select(F.col(key).alias("_k"), F.col(right_t).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), payload.alias("_p"))
    ).withColumn("_b", F.floor(F.col("_t") / bucket))
    inherited = both.filter("_side = 0").groupBy("_k", "_b").agg(F.max("_p").alias("_last"))
    marks = both.select("_k", "_b").distinct().join(inherited, ["_k", "_b"], "left").withColumn("_before", F.last("_last", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("_k", "_b", "_before")
    own = Window.partitionBy("_k", "_b").orderBy("_t", "_side", "_p").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_own", F.last("_p", ignorenulls=True).over(own)).filter("_side = 1").join(marks, ["_k", "_b"], "left").withColumn("_f", F.coalesce("_own", "_before"))
    age = F.col("_t") - F.col("_f.t")
    ok = F.lit(True) if tolerance is None else age <= tolerance
    return found.select("_row.*", *(F.when(ok, F.col(f"_f.{c}")).alias(c) for c in columns), F.when(ok, age).alias("asof_age"))


def ranked(rows: DataFrame, key: str, t: str, *ties: str, bucket: int = 86400) -> DataFrame:
    """rows with `rank`, their number from 1 by time and ties within their key: counts of the time buckets run within a key, numbers within a bucket."""
    cut = rows.withColumn("_b", F.floor(F.col(t) / bucket))
    run = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per key and bucket
    before = cut.groupBy(key, "_b").agg(F.count("*").alias("_n")).select(F.col(key).alias("_k"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_o"))
    own = F.row_number().over(Window.partitionBy(key, "_b").orderBy(t, *ties))
    return cut.withColumn("_r", own).join(before, F.col(key).eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_c"))).withColumn("rank", F.col("_o") + F.col("_r")).drop("_b", "_r", "_k", "_c", "_o")


def asof_valid(left: DataFrame, right: DataFrame, key: str, asof_t: str, target_t: str, back: int = 24, bucket: int = 86400) -> DataFrame:
    """left with `flag` of the newest right row (available, start, stop, flag) available by asof_t whose [start, stop) holds target_t, among the last `back` available.

    Ranks are numbers by availability over the right table, so the look-back is a range of ranks after one as-of join. Equal questions
    (key, rank, target) are asked once and meet `back` rows at most; a busy key is many tasks throughout.
    """
    numbered = ranked(right, key, "available", "start", "stop", bucket=bucket)
    newest = asof(left, numbered, key, asof_t, "available", ["rank"], bucket=bucket)
    asked = newest.filter("rank is not null").select(F.col(key).alias("_k"), F.col("rank").alias("_newest"), F.col(target_t).alias("_target")).distinct()
    near = asked.withColumn("rank", F.explode(F.sequence(F.greatest(F.col("_newest") - back + 1, F.lit(1)), "_newest")))
    met = near.join(numbered.select(F.col(key).alias("_k"), "rank", "start", "stop", "flag"), ["_k", "rank"])
    hit = met.filter((F.col("start") <= F.col("_target")) & (F.col("_target") < F.col("stop")))
    best = hit.groupBy("_k", "_newest", "_target").agg(F.max_by("flag", "rank").alias("flag"))
    both = newest.join(best, (F.col(key) == F.col("_k")) & (F.col("rank") == F.col("_newest")) & (F.col(target_t) == F.col("_target")), "left")
    return both.select(*left.columns, "flag")


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The newest row of each key; ties by the later columns of the order. One aggregation with map-side maxima, no sort of whole keys."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def look_back(origins: DataFrame, frames: DataFrame, key: str = "route", ages: int = 2) -> DataFrame:
    """origins(key, bin) with value and status (ok, rejected, missing) of the newest accepted frame at most `ages` bins old.

    frames(key, bin, value, accepted); each origin meets ages + 1 bins by equality.
    """
    near = origins.select(key, "bin").withColumn("age", F.explode(F.sequence(F.lit(0), F.lit(ages)))).withColumn("at", F.col("bin") - F.col("age"))
    met = near.join(frames.select(key, F.col("bin").alias("at"), "value", "accepted"), [key, "at"], "left")
    got = met.groupBy(key, "bin").agg(F.max_by("value", F.when(F.col("accepted"), F.col("at"))).alias("value"), F.max("accepted").alias("_any"), F.count("accepted").alias("_n"))
    return got.select(key, "bin", "value", F.when(F.coalesce("_any", F.lit(False)), "ok").when(F.col("_n") > 0, "rejected").otherwise("missing").alias("status"))


def trailing_sum(points: DataFrame, readings: DataFrame, window_s: int, key: str, t: str = "t", bucket: int = 86400) -> DataFrame:
    """points with the sum of the readings in (t - window_s, t] of the key, null if there is none: a range frame over the union.

    Time is cut into buckets no shorter than the window, so that a busy key is many tasks; a reading also visits the bucket after its own
    if a point there can see it.
    """
    size = max(bucket, window_s)
    home = F.floor(F.col(t) / size)
    both = points.select(key, t, F.lit(None).cast("double").alias("r"), F.lit(1).alias("p"), home.alias("_b")).unionAll(
        readings.select(key, t, F.col("value").cast("double").alias("r"), F.lit(0).alias("p"), F.explode(F.array_distinct(F.array(home, F.floor((F.col(t) + window_s - 1) / size)))).alias("_b"))
    )
    w = Window.partitionBy(key, "_b").orderBy(t).rangeBetween(-window_s + 1, 0)
    return both.withColumn("total", F.sum("r").over(w)).filter("p = 1").select(key, t, "total")


def latest_fresh(df: DataFrame, key: str, t: str, value: str, now: int, most_s: int, tie: str) -> DataFrame:
    """Per key the age of the newest reading, and its value unless it is older than most_s; of equal times that of the largest tie."""
    newest = df.groupBy(key).agg(F.max(F.struct(t, F.col(tie).alias("_tie"), value)).alias("_m"))
    age = F.lit(now) - F.col(f"_m.{t}")
    return newest.select(key, age.alias("age"), F.when(age <= most_s, F.col(f"_m.{value}")).alias("value"))
