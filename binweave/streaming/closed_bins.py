"""Closed bins of a stream: a bin is final once its end and a grace have passed, which is what a watermark in append mode says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import bins


def closed(df: DataFrame, now: int, grace_s: int = 60, width_s: int = 600) -> DataFrame:
    """Batch: the bins (route, bin, y, n) closed at `now`, in seconds."""
    return bins.binned(df).filter((F.col("bin") + 1) * width_s + grace_s <= F.lit(now))


def closed_bins(stream: DataFrame, grace: str = "60 seconds", width: str = "10 minutes") -> DataFrame:
    """Streaming: emitted once, when closed; later observations of a closed bin are dropped."""
    w = F.window("ts", width)
    out = stream.filter("value is not null").withWatermark("ts", grace).groupBy("route", w.alias("w")).agg(F.avg("value").alias("y"), F.count("*").alias("n"))
    return out.select("route", (F.unix_seconds("w.start") / F.lit(600)).cast("long").alias("bin"), "y", "n")


def once_per_bin(stream: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """Idempotent ingest: the first row of each key within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def monitored(forecasts: DataFrame, actuals: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Stream-stream join of forecasts (route, target_ts, forecast) with the bins they were for (route, bin_ts, y)."""
    f, a = forecasts.withWatermark("target_ts", delay).alias("f"), actuals.withWatermark("bin_ts", delay).alias("a")
    on = (F.col("f.route") == F.col("a.route")) & (F.col("f.target_ts") == F.col("a.bin_ts"))
    if "observed_ts" in actuals.columns:  # a label is observed when its bin has closed, not before and not long after
        on = on & F.col("a.observed_ts").between(F.col("f.target_ts") + F.expr("interval 10 minutes"), F.col("f.target_ts") + F.expr(f"interval {delay}"))
    return f.join(a, on).select("f.route", "f.target_ts", "f.forecast", F.col("a.y").alias("actual"))


def run_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all that is available to Parquet, and end."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def live_cycle(stream: DataFrame, score, path: str, checkpoint: str) -> StreamingQuery:
    """For each micro-batch: score(batch) -> forecasts, in a folder of the batch's number, so that a batch that is tried again writes no row twice."""

    def cycle(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
