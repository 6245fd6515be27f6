"""Seeded stratified samples: equal quotas per hour bucket, within a bucket the periods take turns, each turn by hash.

Nothing is drawn from a generator: a row's order is an MD5 of the seed and its id, so that the
sample is the same on any partitioning. Ranks up to the quota are all that leaves a task (Spark
puts a group limit ahead of the exchange), whatever the size of a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The small hours 2 to 5 are one bucket, every other hour is one.
HOUR_BUCKETS = [(0,), (1,), (2, 3, 4, 5), *((h,) for h in range(6, 24))]


def hour_bucket(hour: Column) -> Column:
    """The number of an hour's bucket."""
    return F.element_at(F.create_map(*(F.lit(x) for i, own in enumerate(HOUR_BUCKETS) for h in own for x in (h, i))), hour.cast("int"))


def _order(seed: int, *of: Column | str) -> Column:
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *((F.col(c) if isinstance(c, str) else c).cast("string") for c in of)))


def quotas(rows: DataFrame, n: int, seed: int, bucket: str, buckets: int) -> DataFrame:
    """(bucket, quota): n shared equally, what is left over to buckets chosen by the seed."""
    base, extra = divmod(n, buckets)
    plus = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(_order(seed, "id"))) <= extra  # one row per bucket
    return rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias(bucket), (F.lit(base) + plus.cast("int")).alias("quota"))


def stratified(rows: DataFrame, n: int, bucket: str, period: str, row_id: str, seed: int = 0, buckets: int = len(HOUR_BUCKETS)) -> DataFrame:
    """rows with `turn`: n of them, an equal quota per bucket; periods take turns until they have no rows left, so that a quota is met if the bucket has as many.

    Null buckets are no part of the sample; rows of one id are taken in no stated order.
    """
    most = -(-n // buckets)
    each = Window.partitionBy(bucket, period).orderBy(_order(seed, bucket, period, row_id), row_id)
    drawn = rows.filter(F.col(bucket).isNotNull()).withColumn("_round", F.row_number().over(each)).filter(F.col("_round") <= most)
    turns = Window.partitionBy(bucket).orderBy("_round", _order(seed, bucket, "_round", period), period, row_id)
    ranked = drawn.withColumn("turn", F.row_number().over(turns)).filter(F.col("turn") <= most)
    return ranked.join(F.broadcast(quotas(rows, n, seed, bucket, buckets)), bucket).filter(F.col("turn") <= F.col("quota")).drop("_round", "quota")


def shortfalls(sample: DataFrame, n: int, bucket: str, seed: int = 0, buckets: int = len(HOUR_BUCKETS)) -> DataFrame:
    """(bucket, short): buckets with fewer rows than their quota."""
    have = sample.groupBy(bucket).agg(F.count("*").alias("_n"))
    return quotas(sample, n, seed, bucket, buckets).join(have, bucket, "left").select(bucket, (F.col("quota") - F.coalesce("_n", F.lit(0))).alias("short")).filter("short > 0")
