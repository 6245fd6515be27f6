"""Queries over binned event series, with independent SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, bins, calendar, lags, seasonal
from .catalog import register

BINS = "bins as (select event_type as route, cast(floor(epoch(ts)/{w}) as bigint) as bin, avg(value) as y, count(*) as n from events where value is not null group by 1, 2)"
B10, B60 = BINS.format(w=600), BINS.format(w=3600)


def events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.withColumn("route", F.col("event_type"))


def ten_minutes(spark: SparkSession, d: str) -> DataFrame:
    return bins.binned(events(spark, d))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    from ..spec import SeriesSpec

    return bins.binned(events(spark, d), SeriesSpec(width_s=3600))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@register("a1_bins_10min", f"with {B10} select route, bin, round(y,6) as y, n from bins")
def a1(spark, d):
    return rounded(ten_minutes(spark, d), "y")


@register("p5_bin_start", "select event_id, cast(floor(epoch(time_bucket(interval 10 minutes, ts))) as bigint) as bin_start from events")
def p5(spark, d):
    return events(spark, d).select("event_id", (bins.bin_of("ts") * 600).alias("bin_start"))


@register("w1_gap_minutes", f"with {B10} select route, bin, (bin - lag(bin) over (partition by route order by bin)) * 10 as gap_min from bins")
def w1(spark, d):
    return bins.with_gap(ten_minutes(spark, d)).select("route", "bin", "gap_min")


GAPS = f"{B10}, gaps as (select *, coalesce((bin - lag(bin) over (partition by route order by bin)) * 10, 0) as g from bins), ag as (select *, cast(max(case when g > 25 then 1 else 0 end) over (partition by route order by bin rows between 6 preceding and current row) as bigint) as after_gap from gaps)"


def with_gaps(spark, d) -> DataFrame:
    return bins.with_after_gap(bins.with_gap(ten_minutes(spark, d)))


@register("w4_after_gap", f"with {GAPS} select route, bin, after_gap from ag")
def w4(spark, d):
    return with_gaps(spark, d).select("route", "bin", "after_gap")


@register("w2_positional_lags", f"with {B10} select route, bin, round(lag(y,1) over w,6) as lag_1, round(lag(y,2) over w,6) as lag_2, round(lag(y,3) over w,6) as lag_3, round(lag(y,6) over w,6) as lag_6, round(lag(y,1) over w - lag(y,4) over w,6) as slope from bins window w as (partition by route order by bin)")
def w2(spark, d):
    return rounded(lags.positional_lags(ten_minutes(spark, d)), "lag_1", "lag_2", "lag_3", "lag_6", "slope").drop("y", "n")


@register("w3_roll_mean", f"with {B10} select route, bin, round(avg(y) over (partition by route order by bin rows between 3 preceding and 1 preceding),6) as roll_3, round(avg(y) over (partition by route order by bin rows between 6 preceding and 1 preceding),6) as roll_6 from bins")
def w3(spark, d):
    return rounded(lags.positional_means(ten_minutes(spark, d)), "roll_3", "roll_6").drop("y", "n")


@register("w5_positional_labels", f"with {B10}, l as (select *, lead(y,3) over w as l3, lead(y,6) over w as l6, lead(bin,3) over w as b3, lead(bin,6) over w as b6 from bins window w as (partition by route order by bin)) select route, bin, round(l3,6) as lead_3, round(l6,6) as lead_6, cast(coalesce(b3 - bin = 3, false) as bigint) as exact_3, cast(coalesce(b6 - bin = 6, false) as bigint) as exact_6 from l")
def w5(spark, d):
    return rounded(lags.positional_labels(ten_minutes(spark, d)), "lead_3", "lead_6").drop("y", "n")


_J = " ".join(f"left join bins l{k} on l{k}.route = b.route and l{k}.bin = b.bin - {k}" for k in range(1, 7)) + " left join bins p3 on p3.route = b.route and p3.bin = b.bin + 3 left join bins p6 on p6.route = b.route and p6.bin = b.bin + 6"
_mean = lambda k: "(" + " + ".join(f"coalesce(l{i}.y, 0)" for i in range(1, k + 1)) + ") / nullif(" + " + ".join(f"(l{i}.y is not null)::int" for i in range(1, k + 1)) + ", 0)"
TIMED = f"{GAPS}, timed as (select b.route, b.bin, b.after_gap, b.y, b.n, " + ", ".join(f"case when b.after_gap = 0 then l{k}.y end as lag_{10 * k}" for k in range(1, 7)) + f", case when b.after_gap = 0 then {_mean(3)} end as roll_mean_30, case when b.after_gap = 0 then {_mean(6)} end as roll_mean_60, case when b.after_gap = 0 then l1.y - l4.y end as slope_30, p3.y as y_30, p6.y as y_60, b.y as y_persistence from ag b {_J})"
_T = [*(f"lag_{10 * k}" for k in range(1, 7)), "roll_mean_30", "roll_mean_60", "slope_30", "y_30", "y_60", "y_persistence"]


def timed(spark, d) -> DataFrame:
    return lags.timed_features(with_gaps(spark, d)).drop("gap_min")


@register("w6_timed_features", f"with {TIMED} select route, bin, after_gap, " + ", ".join(f"round({c},6) as {c}" for c in _T) + " from timed")
def w6(spark, d):
    return rounded(timed(spark, d).drop("y", "n"), *_T)


_CAL = """select *, cast(floor((bin*600+28800)/86400) as bigint) as local_day, cast(floor(((bin*600+28800) % 86400)/60) as bigint) as tod_min from {t}"""
_CALS = """tod_min, round(sin(2*pi()*tod_min/1440),6) as tod_sin, round(cos(2*pi()*tod_min/1440),6) as tod_cos, cast(floor(tod_min/5) as bigint) as tod_block,
 cast(dayofweek(to_timestamp(bin*600+28800)::timestamp) + 1 as bigint) as dow, cast((dayofweek(to_timestamp(bin*600+28800)::timestamp) in (0,6)) as bigint) as is_weekend,
 cast((tod_min >= 360 and tod_min < 660) as bigint) as is_morning_peak, cast((tod_min >= 960 and tod_min < 1320) as bigint) as is_evening_peak, local_day"""


@register("p7_calendar", f"set timezone='UTC'; with {B10}, c as ({_CAL.format(t='bins')}) select route, bin, {_CALS} from c".replace("set timezone='UTC'; ", "").replace("to_timestamp(bin*600+28800)::timestamp", "(timestamp '1970-01-01' + to_seconds(bin*600+28800))"))
def p7(spark, d):
    return rounded(calendar.with_calendar(ten_minutes(spark, d)), "tod_sin", "tod_cos").drop("y", "n")


_CALS = _CALS.replace("to_timestamp(bin*600+28800)::timestamp", "(timestamp '1970-01-01' + to_seconds(bin*600+28800))")


@register("p10_slices", f"with {B10}, c as ({_CAL.format(t='bins')}), s as (select route, bin, {_CALS} from c) select route, bin, case when is_morning_peak = 1 then 'morning' when is_evening_peak = 1 then 'evening' else 'other' end as period, case when is_weekend = 1 then 'weekend' else 'weekday' end as day_type, case when tod_min between 420 and 1139 then 'day' else 'night' end as light from s")
def p10(spark, d):
    return calendar.with_slices(calendar.with_calendar(ten_minutes(spark, d))).select("route", "bin", "period", "day_type", "light")


@register("p8_calendar_monday", f"with {B10}, c as ({_CAL.format(t='bins')}), m as (select route, bin, cast((isodow((timestamp '1970-01-01' + to_seconds(bin*600+28800))) - 1) as bigint) as monday_dow, local_day from c) select route, bin, monday_dow, round(sin(2*pi()*monday_dow/7),6) as dow_sin, round(cos(2*pi()*monday_dow/7),6) as dow_cos, cast((monday_dow >= 5 or local_day in (19723, 19724)) as bigint) as nonworkday from m")
def p8(spark, d):
    return rounded(calendar.monday_based(calendar.with_calendar(ten_minutes(spark, d)), [19723, 19724]), "dow_sin", "dow_cos").select("route", "bin", "monday_dow", "dow_sin", "dow_cos", "nonworkday")


@register("training_set_view", f"with {TIMED}, c as ({_CAL.format(t='timed')}) select route, bin, after_gap, " + ", ".join(f"round({c},6) as {c}" for c in _T) + f", {_CALS} from c")
def training_set(spark, d):
    """The causal training set: bins, gap logic, timed lags and labels, calendar."""
    return rounded(calendar.with_calendar(timed(spark, d)).drop("y", "n"), *_T, "tod_sin", "tod_cos")


@register("p11_scorable", f"with {TIMED} select route, bin, round(y_30,6) as y_30, cast(route = 'click' as bigint) as is_first from timed where y_30 is not null and after_gap = 0")
def p11(spark, d):
    return rounded(timed(spark, d).filter("y_30 is not null and after_gap = 0").select("route", "bin", "y_30", (F.col("route") == "click").cast("long").alias("is_first")), "y_30")


@register("p20_regime", f"with {TIMED} select route, bin, case when y_30 - y_persistence > 5 then 'rising' when y_30 - y_persistence < -5 then 'falling' else 'steady' end as regime from timed where y_30 is not null")
def p20(spark, d):
    change = F.col("y_30") - F.col("y_persistence")
    return timed(spark, d).filter("y_30 is not null").select("route", "bin", F.when(change > 5, "rising").when(change < -5, "falling").otherwise("steady").alias("regime"))


_GRID = f"{B10}, span as (select route, min(bin) a, max(bin) b from bins group by 1), grid as (select s.route, g.bin, x.y from span s, lateral (select unnest(generate_series(s.a, s.b)) as bin) g left join bins x on x.route = s.route and x.bin = g.bin)"


def grid(spark, d) -> DataFrame:
    return bins.dense(ten_minutes(spark, d)).select("route", "bin", "y")


@register("w9_grid", f"with {_GRID} select route, cast(bin as bigint) as bin, round(y,6) as y from grid")
def w9(spark, d):
    return rounded(grid(spark, d), "y")


@register("w8_ffill", f"with {_GRID} select route, cast(bin as bigint) as bin, round(last_value(y ignore nulls) over (partition by route order by bin rows between 3 preceding and current row),6) as y_filled from grid")
def w8(spark, d):
    return rounded(bins.filled(grid(spark, d), 3), "y_filled").drop("y")


@register("w11_segment", f"with {_GRID}, f as (select route, bin, last_value(y ignore nulls) over (partition by route order by bin rows between 3 preceding and current row) as y_filled from grid), h as (select route, max(case when y_filled is null then bin end) as hole, max(bin) as e from f group by 1) select f.route, cast(f.bin as bigint) as bin, round(f.y_filled,6) as y_filled from f join h on f.route = h.route where f.bin > coalesce(h.hole, -1)")
def w11(spark, d):
    return rounded(bins.last_segment(bins.filled(grid(spark, d), 3)), "y_filled").drop("y")


_HGRID = _GRID.replace(B10, B60)


def hourly_grid(spark, d) -> DataFrame:
    return bins.dense(hourly(spark, d)).select("route", "bin", "y")


@register("w12_tod7", f"with {_HGRID} select a.route, cast(a.bin as bigint) as bin, round(avg(b.y),6) as tod from grid a left join grid b on b.route = a.route and b.bin % 24 = a.bin % 24 and b.bin between a.bin - 168 and a.bin - 1 group by 1, 2")
def w12(spark, d):
    return rounded(seasonal.same_time_mean(hourly_grid(spark, d), 24), "tod").drop("y")


_O = "left join grid {n} on {n}.route = g.route and {n}.bin = g.bin - {k}"


@register("w13_origin_features", f"with {_HGRID}, six as (select a.route, a.bin, count(b.y) as c, avg(b.y) as m, stddev_pop(b.y) as s from grid a join grid b on b.route = a.route and b.bin between a.bin - 5 and a.bin group by 1, 2) select g.route, cast(g.bin as bigint) as bin, " + ", ".join(f"round(g.y - p{k}.y,6) as delta_{k}" for k in (1, 2, 3, 6)) + ", round(case when six.c = 6 then six.m - g.y end,6) as mean_gap, round(case when six.c = 6 then six.s end,5) as deviation, " + ", ".join(f"round(d{n}.y - g.y,6) as gap_d{n}, cast(d{n}.y is null as bigint) as missing_d{n}" for n in (1, 7)) + " from grid g join six on six.route = g.route and six.bin = g.bin " + " ".join(_O.format(n=f"p{k}", k=k) for k in (1, 2, 3, 6)) + " " + " ".join(_O.format(n=f"d{n}", k=24 * n) for n in (1, 7)))
def w13(spark, d):
    out = seasonal.origin_features(hourly_grid(spark, d), 24).drop("y", "d1", "d7")
    return rounded(rounded(out, "delta_1", "delta_2", "delta_3", "delta_6", "mean_gap", "gap_d1", "gap_d7"), "deviation", digits=5)


@register("w15_blend", f"with {_HGRID} select g.route, cast(g.bin as bigint) as bin, round((coalesce(d1.y*0.7,0)+coalesce(d7.y*0.3,0))/nullif((d1.y is not null)::int*0.7+(d7.y is not null)::int*0.3,0),6) as blend from grid g {_O.format(n='d1', k=24)} {_O.format(n='d7', k=168)}")
def w15(spark, d):
    g = hourly_grid(spark, d).withColumns({"d1": lags.at_offset("y", -24), "d7": lags.at_offset("y", -168)})
    return rounded(g.select("route", "bin", seasonal.blended(F.col("d1"), F.col("d7"), 0.7, 0.3).alias("blend")), "blend")


_ES = "ev as (select event_id, user_id, event_type, value, cast(floor(epoch(ts)) as bigint) as t from events)"


def raw(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value", bins.seconds("ts").alias("t"))


@register("j10_asof", f"with {_ES}, l as (select * from ev where event_id % 2 = 0), r as (select user_id, t, max(value) as value from ev where event_id % 2 = 1 group by 1, 2) select l.event_id, l.t, round(case when l.t - r.t <= 86400 then r.value end,6) as seen, case when l.t - r.t <= 86400 then l.t - r.t end as asof_age from l asof left join r on l.user_id = r.user_id and l.t >= r.t")
def j10(spark, d):
    """The latest odd event of a user at or before each even one, at most a day old."""
    e = raw(spark, d)
    out = asof.asof(e.filter("event_id % 2 = 0").select("event_id", "user_id", "t"), e.filter("event_id % 2 = 1").select("user_id", F.col("t").alias("rt"), F.col("value").alias("seen")), "user_id", "t", "rt", ["seen"], 86400, 7 * 86400)
    return rounded(out.select("event_id", "t", "seen", "asof_age"), "seen")


@register("j11_asof_valid", f"with {_ES}, l as (select event_id, user_id, t, t + 1800 as target from ev where event_id % 4 = 0), r as (select user_id, t as available, t - 3600 as start, t + 7200 as stop, max(value) as flag from ev where event_id % 4 = 1 group by 1, 2), k as (select *, row_number() over (partition by user_id order by available) as rank from r), n as (select l.event_id, max(k.rank) as newest from l join k on k.user_id = l.user_id and k.available <= l.t group by 1) select l.event_id, round((select arg_max(k.flag, k.rank) from k where k.user_id = l.user_id and k.rank <= n.newest and k.rank > n.newest - 24 and k.start <= l.target and l.target < k.stop),6) as flag from l left join n on n.event_id = l.event_id")
def j11(spark, d):
    e = raw(spark, d)
    left = e.filter("event_id % 4 = 0").select("event_id", "user_id", "t", (F.col("t") + 1800).alias("target"))
    right = e.filter("event_id % 4 = 1").groupBy("user_id", F.col("t").alias("available")).agg(F.max("value").alias("flag")).withColumns({"start": F.col("available") - 3600, "stop": F.col("available") + 7200})
    return rounded(asof.asof_valid(left, right, "user_id", "t", "target").select("event_id", "flag"), "flag")


@register("j12_latest", f"with {_ES} select user_id, event_type, event_id, t from (select *, row_number() over (partition by user_id, event_type order by t desc, event_id desc) as k from ev) where k = 1")
def j12(spark, d):
    return asof.latest(raw(spark, d), ["user_id", "event_type"], "t", "event_id").select("user_id", "event_type", "event_id", "t")


@register("j13_lookback", f"with {B10} select b.route, b.bin, round((select arg_max(f.y, f.bin) from bins f where f.route = b.route and f.bin between b.bin - 2 and b.bin and f.n >= 2),6) as value, case when exists (select 1 from bins f where f.route = b.route and f.bin between b.bin - 2 and b.bin and f.n >= 2) then 'ok' else 'rejected' end as status from bins b")
def j13(spark, d):
    b = ten_minutes(spark, d)
    return rounded(asof.look_back(b, b.select("route", "bin", F.col("y").alias("value"), (F.col("n") >= 2).alias("accepted"))), "value")


@register("a7_range_sum", f"with {_ES}, pts as (select distinct event_type, cast(floor(t/600) as bigint)*600 as t from ev) select p.event_type, p.t, round((select sum(value) from ev r where r.event_type = p.event_type and r.t > p.t - 3600 and r.t <= p.t),6) as total from pts p")
def a7(spark, d):
    e = raw(spark, d)
    points = e.select("event_type", (F.floor(F.col("t") / 600).cast("long") * 600).alias("t")).distinct()
    return rounded(asof.trailing_sum(points, e, 3600, "event_type"), "total")


_CTX = f"{_HGRID}, f as (select route, bin, y, last_value(y ignore nulls) over (partition by route order by bin rows between 2 preceding and current row) as filled from grid), o as (select distinct route, bin from bins where bin % 24 = 12), c as (select o.route, o.bin as origin, f.bin, f.filled, f.y from o join f on f.route = o.route and f.bin between o.bin - 47 and o.bin), h as (select route, origin, max(case when filled is null then bin end) as hole, max(case when bin = origin then y end) as at_origin from c group by 1, 2)"


@register("context_query", f"with {_CTX}, k as (select c.* from c join h on h.route = c.route and h.origin = c.origin where h.at_origin is not null and c.bin > coalesce(h.hole, -1)), n as (select route, origin, count(*) as context, avg(filled) as mean from k group by 1, 2 having count(*) >= 12) select n.route, cast(n.origin as bigint) as origin, n.context, round(n.mean,9) as mean, round(a.y,6) as actual, round(p.y,6) as persistence, round(d1.y,6) as d1, round(d7.y,6) as d7 from n left join grid a on a.route = n.route and a.bin = n.origin + 3 left join grid p on p.route = n.route and p.bin = n.origin left join grid d1 on d1.route = n.route and d1.bin = n.origin + 3 - 24 left join grid d7 on d7.route = n.route and d7.bin = n.origin + 3 - 168")
def context_query(spark, d):
    """Per origin: the filled context after its last hole, with actual, persistence and seasonal values at the target."""
    g = bins.filled(hourly_grid(spark, d), 2, to="filled")
    at = g.withColumns({"actual": lags.at_offset("y", 3), "persistence": F.col("y"), "d1": lags.at_offset("y", 3 - 24), "d7": lags.at_offset("y", 3 - 168)})
    origins = at.filter("bin % 24 = 12 and y is not null").select("route", F.col("bin").alias("origin"), "actual", "persistence", "d1", "d7")
    context = origins.withColumn("bin", F.explode(F.sequence(F.col("origin") - 47, "origin"))).join(g.select("route", "bin", "filled", F.lit(1).alias("there")), ["route", "bin"]).withColumn("hole", F.when(F.col("filled").isNull(), F.col("bin")))
    keys = ["route", "origin", "actual", "persistence", "d1", "d7"]
    rows = context.groupBy(*keys).agg(F.max("hole").alias("hole"), F.collect_list(F.struct("bin", "filled")).alias("c"))  # 48 bins at most
    kept = rows.withColumn("c", F.filter("c", lambda x: x["bin"] > F.coalesce("hole", F.lit(-1)))).filter(F.size("c") >= 12)
    mean = F.aggregate("c", F.lit(0.0), lambda s, x: s + x["filled"]) / F.size("c")
    return rounded(kept.select("route", "origin", F.size("c").cast("long").alias("context"), F.round(mean, 9).alias("mean"), "actual", "persistence", "d1", "d7"), "actual", "persistence", "d1", "d7")
