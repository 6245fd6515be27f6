"""Streaming queries over a given table: it arrives in slices, with late and repeated rows and a restart between slices; SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bins
from ..streaming import arrivals, closed_bins, state
from .catalog import register
from .series_queries import B10, GAPS, rounded

SLICES = 4
#: Slices by day; every 97th event arrives a slice late.
_ARRIVAL = f"least({SLICES - 1}, cast(floor((epoch(ts) - lo)/(hi - lo + 1)*{SLICES}) as bigint) + (event_id % 97 = 0)::int)"
_ARRIVED = f"lim as (select min(epoch(ts)) as lo, max(epoch(ts)) as hi from events), ar as (select event_id, event_type as route, value, ts, cast(floor(epoch(ts)/600) as bigint) as bin, {_ARRIVAL} as arrival from events, lim)"
#: Events of a bin that an earlier slice's newest event, less the grace, has closed are late.
_KEPT = f"{_ARRIVED}, wm as (select arrival, max(epoch(ts)) as top from ar where value is not null group by 1), kept as (select ar.* from ar where value is not null and (bin + 1)*600 > coalesce((select max(top) from wm where wm.arrival < ar.arrival) - 60, -1e18)), st as (select route, bin, avg(value) as y, count(*) as n from kept group by 1, 2), fin as (select st.* from st where (bin + 1)*600 <= (select max(top) from wm) - 60)"


def arriving(spark, d) -> DataFrame:
    """Events with their slice of arrival."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("event_type").alias("route"), "ts", "value").withColumns({"t": bins.seconds("ts"), "at": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6})
    lim = e.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    late = (F.col("event_id") % 97 == 0).cast("long")
    own = F.floor((F.col("at") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1) * SLICES) + late
    return e.join(F.broadcast(lim)).withColumn("arrival", F.least(F.lit(SLICES - 1), own)).select("event_id", "route", F.timestamp_seconds("t").alias("ts"), "value", "arrival")


@register("st2_streamed_bins", f"with {_KEPT} select route, bin, round(y,6) as y, n from fin")
def st2(spark, d):
    """Closed bins from the stream's sink: windows with a watermark, late events of closed bins left out, the query restarted between slices."""
    out = arrivals.replayed(arriving(spark, d).select("route", "ts", "value", "arrival"), "arrival", SLICES, lambda s, path, check: closed_bins.run_available(closed_bins.closed_bins(s), path, check), "st2")
    return rounded(spark.read.schema("route string, bin long, y double, n long").parquet(out), "y")


@register("st10_late_events", f"with {_KEPT}, b as (select route, bin, count(*) as n from ar where value is not null group by 1, 2) select b.route, b.bin, b.n - fin.n as late from b join fin on fin.route = b.route and fin.bin = b.bin where b.n > fin.n")
def st10(spark, d):
    """Events that came after their bin was closed: what the batch has of the streamed bins and the stream has not."""
    e = arriving(spark, d)
    out = arrivals.replayed(e.select("route", "ts", "value", "arrival"), "arrival", SLICES, lambda s, path, check: closed_bins.run_available(closed_bins.closed_bins(s), path, check), "st10")
    whole = bins.binned(e).select("route", "bin", F.col("n").alias("_all"))
    both = spark.read.schema("route string, bin long, y double, n long").parquet(out).join(whole, ["route", "bin"])
    return both.select("route", "bin", (F.col("_all") - F.col("n")).alias("late")).filter("late > 0")


@register("st6_ingested_once", "select event_id, event_type as route, round(value,6) as value from events")
def st6(spark, d):
    """Idempotent ingest: every slice is delivered twice, every event gets in once."""
    run = lambda s, path, check: closed_bins.run_available(closed_bins.once_per_bin(s, ["event_id"], "30 days"), path, check)
    out = arrivals.replayed(arriving(spark, d), "arrival", SLICES, run, "st6", repeat=True)
    return rounded(spark.read.schema("event_id long, route string, ts timestamp, value double").parquet(out).select("event_id", "route", "value"), "value")


def binned_slices(spark, d) -> DataFrame:
    """Bins (route, bin, y) in slices of whole days, by the table's span."""
    b = bins.binned(spark.read.parquet(f"{d}/events.parquet").withColumn("route", F.col("event_type"))).select("route", "bin", "y")
    lim = b.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    return b.join(F.broadcast(lim)).withColumn("arrival", F.floor((F.col("bin") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1) * SLICES)).drop("lo", "hi")


@register("st5_labelled", f"with {B10} select f.route, f.bin + 3 as target, round(f.y,6) as forecast, round(a.y,6) as actual from bins f join bins a on a.route = f.route and a.bin = f.bin + 3")
def st5(spark, d):
    """Forecasts wait in the stream's state for the label, which is seen ten minutes after its bin began."""
    at = lambda c: F.timestamp_seconds(F.col(c) * 600)

    def run(s, path, check):
        f = s.select("route", at("target").alias("target_ts"), "forecast").filter("forecast is not null")
        a = s.select("route", at("bin").alias("bin_ts"), "y", (at("bin") + F.expr("interval 10 minutes")).alias("observed_ts"))
        return closed_bins.run_available(closed_bins.monitored(f, a, "30 days"), path, check)

    rows = binned_slices(spark, d).select("route", "bin", "y", (F.col("bin") + 3).alias("target"), F.col("y").alias("forecast"), "arrival")
    out = spark.read.schema("route string, target_ts timestamp, forecast double, actual double").parquet(arrivals.replayed(rows, "arrival", SLICES, run, "st5"))
    return rounded(out.select("route", (F.unix_seconds("target_ts") / 600).cast("long").alias("target"), "forecast", "actual"), "forecast", "actual")


@register(
    "st11_running_state",
    f"with recursive {GAPS}, n as (select route, bin, y, row_number() over (partition by route order by bin) as i, lag(bin) over (partition by route order by bin) as p from bins), s as (select route, bin, i, y as limited from n where i = 1 union all select n.route, n.bin, n.i, s.limited + greatest(least(n.y - s.limited, 10.0), -10.0) from s join n on n.route = s.route and n.i = s.i + 1) "
    "select n.route, n.bin, round(n.y,6) as y, (n.bin - p)*10 as gap_min, ag.after_gap, round(s.limited,6) as limited from n join s on s.route = n.route and s.i = n.i join ag on ag.route = n.route and ag.bin = n.bin",
)
def st11(spark, d):
    """Gap, after_gap and slew-limited value kept in state from slice to slice; every slice comes twice, and a bin that comes again is no news."""
    with arrivals.rocks_state(spark):
        out = arrivals.replayed(binned_slices(spark, d), "arrival", SLICES, lambda s, path, check: closed_bins.run_available(state.with_running_state(s), path, check), "st11", repeat=True)
    return rounded(spark.read.schema(state.OUTPUT).parquet(out), "y", "limited")


_REGISTRY = "reg as (select route, case when avg(abs(y - p)) <= avg(abs(y - m)) then 'persistence' else 'mean' end as model from (select route, y, lag(y) over w as p, (lag(y) over w + lag(y,2) over w)/2 as m from bins window w as (partition by route order by bin)) group by 1)"


@register("st12_live_cycle", f"with {B10}, {_REGISTRY}, lat as (select route, max(bin) as bin from bins group by 1), f as (select bins.route, bins.bin + 3 as target, y, lag(y) over (partition by bins.route order by bins.bin) as before from bins) select f.route, target, model, round(case when model = 'mean' then (y + coalesce(before, y))/2 else y end,6) as forecast from f join reg on reg.route = f.route")
def st12(spark, d):
    """The live cycle: each micro-batch reads the registry and the bins closed before, forecasts with the served model, and is written under its number."""
    from ..sources.scratch import fresh
    from ..sources.versioned import VersionedTable

    rows = binned_slices(spark, d)
    w = bins.ordered("route")
    tried = rows.withColumns({"p": F.lag("y").over(w), "m": (F.lag("y").over(w) + F.lag("y", 2).over(w)) / 2})
    e = lambda c: F.avg(F.abs(F.col("y") - F.col(c)))
    registry, seen = VersionedTable(spark, fresh(spark, "st12-registry")), VersionedTable(spark, fresh(spark, "st12-bins"))
    registry.append(tried.groupBy("route").agg(F.when(e("p") <= e("m"), "persistence").otherwise("mean").alias("model")))

    def score(batch: DataFrame) -> DataFrame:
        seen.append_new(batch.select("route", "bin", "y"), ["route", "bin"])
        history = seen.read().withColumn("before", F.lag("y").over(w)).join(registry.read(), "route")
        new = history.join(batch.select("route", "bin"), ["route", "bin"], "left_semi")
        value = F.when(F.col("model") == "mean", (F.col("y") + F.coalesce("before", "y")) / 2).otherwise(F.col("y"))
        return new.select("route", (F.col("bin") + 3).alias("target"), "model", value.alias("forecast"))

    out = arrivals.replayed(rows, "arrival", SLICES, lambda s, path, check: closed_bins.live_cycle(s, score, path, check), "st12")
    return rounded(spark.read.schema("route string, target long, model string, forecast double").option("recursiveFileLookup", True).parquet(out), "forecast")
