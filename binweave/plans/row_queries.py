"""Queries of row sets, reads and keyed joins, with independent SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import bins, calendar, joins, rows
from .catalog import register
from .series_queries import B10, B60, GAPS, TIMED, events, hourly, raw, rounded, ten_minutes, timed
from .table_queries import _CAL

OBS = "obs as (select event_id, event_type as route, ts, value, case when event_id % 13 = 0 then 'ERROR' else 'OK' end as status, case when event_id % 7 = 0 then 'carried_forward from ' || event_id when event_id % 13 = 0 then 'timeout' end as error_message from events)"


def observations(spark, d) -> DataFrame:
    """Events as observations with a status and an error message; some are carried, some failed."""
    i = F.col("event_id")
    return events(spark, d).select("event_id", "route", "ts", "value", F.when(i % 13 == 0, "ERROR").otherwise("OK").alias("status"), F.when(i % 7 == 0, F.concat(F.lit("carried_forward from "), i.cast("string"))).when(i % 13 == 0, "timeout").alias("error_message"))


@register("p1_valid_rows", f"with {OBS} select event_id, round(value,6) as value from obs where status = 'OK' and value is not null")
def p1(spark, d):
    return rounded(bins.valid(observations(spark, d), "status").select("event_id", "value"), "value")


@register("p2_strict_route", f"with {OBS} select event_id from obs where route = 'click' and status = 'OK' and value is not null and error_message is null")
def p2(spark, d):
    return rows.strict_route(observations(spark, d), "click").select("event_id")


@register("p3_not_carried", f"with {OBS} select event_id, error_message from obs where not starts_with(coalesce(error_message, ''), 'carried_forward')")
def p3(spark, d):
    return bins.not_carried(observations(spark, d)).select("event_id", "error_message")


@register("p4_ratio_speed", "select l_orderkey, l_linenumber, round(nullif(l_quantity,0)*1.07/nullif(l_linenumber-1,0),4) as ratio, round(nullif(l_quantity,0)*37.13/nullif(l_linenumber-1,0)*3.6,2) as speed from lineitem")
def p4(spark, d):
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber") - 1
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", rows.ratio(q * 1.07, n).alias("ratio"), rows.speed_kmh(q * 37.13, n).alias("speed"))


@register("p6_wall_clock", "select event_id, cast(floor(epoch(date_trunc('minute', ts))/600)*600 - 28800 as bigint) as bin_start from events")
def p6(spark, d):
    """The events' times read as wall-clock times of the series' zone."""
    return events(spark, d).select("event_id", rows.wall_clock_bin(F.col("ts").cast("timestamp")).alias("bin_start"))


_LT = "(timestamp '1970-01-01' + to_seconds(bin*300+28800))"


@register("p9_calendar_five", f"with b as (select distinct event_type as route, cast(floor(epoch(ts)/300) as bigint) as bin from events) select route, bin, cast(hour({_LT}) as bigint) as hour, cast(minute({_LT}) as bigint) as minute, cast(isodow({_LT}) - 1 as bigint) as dayofweek, cast(day({_LT}) as bigint) as day, cast(month({_LT}) as bigint) as month, cast(isodow({_LT}) >= 6 or floor((bin*300+28800)/86400) in (19723, 19740) as bigint) as nonworkday from b")
def p9(spark, d):
    b = events(spark, d).select("route", bins.bin_of("ts", 300).alias("bin")).distinct()
    out = rows.five_minute_calendar(b, (19723, 19740))
    return out.select("route", "bin", *(F.col(c).cast("long").alias(c) for c in ("hour", "minute", "dayofweek", "day", "month", "nonworkday")))


_TR = f"{TIMED}, c as ({_CAL})"


@register("p12_training_rows", f"with {_TR} select route, bin, round(y_30,6) as y_30, round(lag_60,6) as lag_60, cast(local_day % 5 = 0 as bigint) as is_val from c where after_gap = 0 and y_30 is not null and lag_60 is not null")
def p12(spark, d):
    t = rows.training_rows(calendar.with_calendar(timed(spark, d)))
    return rounded(t.select("route", "bin", "y_30", "lag_60", (F.col("local_day") % 5 == 0).cast("long").alias("is_val")), "y_30", "lag_60")


@register("p12_frozen_rows", f"with {_TR} select route, bin from c where after_gap = 0 and y_30 is not null and bin*600 + 2400 <= 1705795200 and local_day not in (19730, 19733)")
def p12_frozen(spark, d):
    return rows.training_rows(calendar.with_calendar(timed(spark, d)), 1705795200, (19730, 19733), ("y_30",)).select("route", "bin")


@register("p13_cutoff", "select event_id, cast(ts <= timestamp '2024-01-20 12:00:00' as bigint) as by_utc from events where ts - interval 8 hours <= timestamp '2024-01-20 12:00:00'")
def p13(spark, d):
    at = F.lit("2024-01-20 12:00:00").cast("timestamp")
    e = events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.cut_off(e, at, local_zone="Asia/Singapore").select("event_id", (F.col("ts") <= at).cast("long").alias("by_utc"))


@register("p14_window_end", "select cast(floor((floor(max(epoch(ts))) - 2400)/600)*600 as bigint) as window_end from events")
def p14(spark, d):
    newest = raw(spark, d).agg(F.max("t").alias("t")).first().t
    return spark.createDataFrame([(rows.window_end(newest),)], "window_end long")


@register("p15_masked_labels", f"with {TIMED} select route, bin, round(case when bin*600 + 1800 >= 1705276800 and bin*600 + 1800 < 1705449600 then null else y_30 end,6) as y_30 from timed")
def p15(spark, d):
    return rounded(rows.masked_labels(timed(spark, d), "y_30", 3, (1705276800, 1705449600)).select("route", "bin", "y_30"), "y_30")


@register("p18_except", "select * exclude (props, ts) from events")
def p18(spark, d):
    return spark.sql("select * except (props, ts) from {e}", e=spark.read.parquet(f"{d}/events.parquet"))


@register("p21_display_level", "select event_id, case when floor(value + 0.5) < 30 then 'low' when floor(value + 0.5) <= 50 then 'medium' else 'high' end as level from events")
def p21(spark, d):
    return events(spark, d).select("event_id", rows.display_level(F.col("value")).alias("level"))


_REQ = "r as (select event_id, case when event_id % 11 = 0 then null else 'horizon=' || case event_id % 5 when 0 then '30' when 1 then '60' when 2 then '45' when 3 then '3x' else '' end || '&direction=' || event_type end as q, case when event_id % 3 = 0 then '{\"horizon\": ' || (event_id % 4 * 30) || ', \"confidence\": \"' || (event_id % 7) / 5.0 || '\"}' end as body from events)"


@register(
    "p23_requests",
    f"with {_REQ}, g as (select event_id, coalesce(json_extract_string(body, '$.horizon'), nullif(regexp_extract(q, '(^|&)horizon=([^&]*)', 2), '')) as h, coalesce(json_extract_string(body, '$.direction'), nullif(regexp_extract(q, '(^|&)direction=([^&]*)', 2), '')) as direction, json_extract_string(body, '$.confidence') as c from r), p as (select event_id, case when h is null then 30 when regexp_full_match(h, '[0-9]+') then cast(h as int) end as horizon, direction, case when c is null then 0.25 else try_cast(c as double) end as confidence from g) select event_id, cast(horizon as bigint) as horizon, direction, round(confidence,6) as confidence, case when horizon is null or horizon not in (30, 60) then 'horizon' when direction not in ('click', 'view', 'error') then 'direction' when confidence is null or confidence not between 0 and 1 then 'confidence' end as problem from p",
)
def p23(spark, d):
    """Requests made from events: body over query string, digits-only horizons, listed directions."""
    i, horizon = F.col("event_id"), F.element_at(F.array(*(F.lit(x) for x in ("30", "60", "45", "3x", ""))), (F.col("event_id") % 5).cast("int") + 1)
    q = F.when(i % 11 != 0, F.concat(F.lit("horizon="), horizon, F.lit("&direction="), F.col("event_type")))
    body = F.when(i % 3 == 0, F.concat(F.lit('{"horizon": '), (i % 4 * 30).cast("string"), F.lit(', "confidence": "'), ((i % 7) / 5.0).cast("string"), F.lit('"}')))
    out = rows.parsed_requests(events(spark, d).withColumns({"q": q, "body": body}), "q", "body", ("click", "view", "error"))
    return rounded(out.select("event_id", F.col("horizon").cast("long").alias("horizon"), "direction", "confidence", "problem"), "confidence")


@register("s9_live_scan", f"with {B10}, m as (select cast(floor(max(epoch(ts))) as bigint) as now from events) select route, bin, round(y,6) as y from bins, m where route in ('click', 'view') and bin*600 >= now - 10800 and bin*600 + 660 <= now")
def s9(spark, d):
    """Closed bins of the last three hours of two series."""
    now = raw(spark, d).agg(F.max("t").alias("t")).first().t
    return rounded(rows.closed_window(ten_minutes(spark, d), ["click", "view"], now).select("route", "bin", "y"), "y")


@register("s10_range_scan", f"with {B10} select route, bin, round(y,6) as y from bins where route in ('click', 'error') and bin*600 >= 1704672000 and bin*600 < 1705276800")
def s10(spark, d):
    return rounded(rows.in_range(ten_minutes(spark, d), ["click", "error"], 1704672000, 1705276800).select("route", "bin", "y"), "y")


@register("s2_single_route", "select event_id, round(value,6) as value from events where event_type = 'purchase' and ts >= timestamp '2024-01-05 00:00:00' and ts < timestamp '2024-01-25 00:00:00'")
def s2(spark, d):
    """A parameterised scan of one series; the predicates reach the Parquet reader."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = spark.sql("select event_id, value from {e} where event_type = :route and ts >= cast(:first as timestamp) and ts < cast(:end as timestamp)", args={"route": "purchase", "first": "2024-01-05 00:00:00", "end": "2024-01-25 00:00:00"}, e=e)
    return rounded(out, "value")


@register("s4_all_types", "select event_id from events where event_type in ('click', 'view') and event_id % 10 = 3 and value > 5.5 and ts not in (timestamp '2024-01-01 00:06:29.165275') and ts >= timestamp '2024-01-02 03:04:05'")
def s4(spark, d):
    """Parameters of every type: text, long, double, boolean, timestamp and arrays of text and timestamps."""
    from datetime import datetime, timezone

    at = lambda *x: datetime(*x, tzinfo=timezone.utc)
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    sql = "select event_id from {e} where array_contains(:types, event_type) and (event_id % :m = 3) = :yes and value > :least and not array_contains(:without, ts) and ts >= :since and event_type <> :never"
    args = {"types": F.array(F.lit("click"), F.lit("view")), "m": 10, "yes": True, "least": 5.5, "without": F.array(F.lit(at(2024, 1, 1, 0, 6, 29, 165275))), "since": at(2024, 1, 2, 3, 4, 5), "never": "none"}
    return spark.sql(sql, args=args, e=e)


@register("j1_pooled", f"with {TIMED} select route, bin, round(y_30,6) as y_30, round(roll_mean_30,6) as a, round(lag_10,6) as b from timed where y_30 is not null and roll_mean_30 is not null and lag_10 is not null")
def j1(spark, d):
    """Two candidates' rows pooled one to one, with their labels the same."""
    t = timed(spark, d).filter("y_30 is not null")
    a = t.filter("roll_mean_30 is not null").select("route", "bin", "y_30", F.col("roll_mean_30").alias("a"))
    b = t.filter("lag_10 is not null").select("route", "bin", "y_30", F.col("lag_10").alias("b"))
    return rounded(joins.pooled(a, b, ["route", "bin"], "y_30"), "y_30", "a", "b")


@register("j2_prepare", f"with {TIMED}, k as (select bin, count(lag_10) as a, count(lag_20) as b, count(*) as n from timed where y_30 is not null group by 1) select cast(sum(n) as bigint) as n, cast(sum(n) - sum(a) as bigint) as without_lag_10, cast(sum(n) - sum(b) as bigint) as without_lag_20 from k")
def j2(spark, d):
    """How many rows each candidate lacks; the rows that all have are what prepare keeps."""
    t = timed(spark, d).filter("y_30 is not null")
    p = {c: t.filter(F.col(c).isNotNull()).select("route", "bin", F.col(c).alias("predicted")) for c in ("lag_10", "lag_20")}
    _, missing = joins.with_predictions(t.select("route", "bin", "y_30"), p, ["route", "bin"])
    return missing.select(F.lit(t.count()).alias("n"), F.col("lag_10").alias("without_lag_10"), F.col("lag_20").alias("without_lag_20"))


@register("j5_weather", "with o as (select cast(floor(epoch(ts)/3600) as bigint) as bin, max((value > 50)::int) as rain, avg(value) as level from events where event_type = 'click' group by 1), f as (select cast(floor(epoch(ts)/3600) as bigint) as bin, max((value > 80)::int) as warned, count(*) as n from events where event_type = 'view' and value > 20 group by 1) select bin, cast(rain as bigint) as rain, round(level,6) as level, cast(warned as bigint) as warned, n from o full join f using (bin)")
def j5(spark, d):
    """Two feeds joined by bin, either of which may be missing, and aggregated by the key that is there."""
    e = raw(spark, d).withColumn("bin", F.floor(F.col("t") / 3600).cast("long"))
    o = e.filter("event_type = 'click'").select("bin", (F.col("value") > 50).cast("long").alias("rain"), F.col("value").alias("level"))
    f = e.filter("event_type = 'view' and value > 20").select("bin", (F.col("value") > 80).cast("long").alias("warned"))
    a = o.groupBy("bin").agg(F.max("rain").alias("rain"), F.avg("level").alias("level"))
    b = f.groupBy("bin").agg(F.max("warned").alias("warned"), F.count("*").alias("n"))
    return rounded(joins.either(a, b, ["bin"]), "level")


@register("a5_bin_weather", "select cast(floor(epoch(ts)/600) as bigint) as bin, cast(max((value > 50)::int) as bigint) as flag, min(event_type) as area, round(avg(value),6) as level from events group by 1")
def a5(spark, d):
    e = raw(spark, d)
    return rounded(e.groupBy(F.floor(F.col("t") / 600).cast("long").alias("bin")).agg(F.max((F.col("value") > 50).cast("long")).alias("flag"), F.min("event_type").alias("area"), F.avg("value").alias("level")), "level")


@register("j6_layer_a", "with e as (select *, cast(floor(epoch(ts)/3600) as bigint) as bin from events), n as (select bin, event_type, event_id, value from (select *, row_number() over (partition by bin, event_type order by ts desc, event_id desc) as k from e) where k = 1), r as (select bin, max(value) filter (event_type = 'error') as ratio from e group by 1) select n.bin, n.event_type, n.event_id, round(r.ratio,6) as ratio from n left join r on r.bin = n.bin where n.event_type <> 'error'")
def j6(spark, d):
    """The newest row of each bin and series, with the bin's largest ratio of another feed."""
    e = raw(spark, d).withColumn("bin", F.floor(F.col("t") / 3600).cast("long"))
    micro = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("u"))
    newest = e.join(micro, "event_id").filter("event_type <> 'error'").groupBy("bin", "event_type").agg(F.max(F.struct("u", "event_id")).alias("m")).select("bin", "event_type", "m.event_id")
    ratio = e.filter("event_type = 'error'").groupBy("bin").agg(F.max("value").alias("ratio"))
    return rounded(newest.join(ratio, "bin", "left"), "ratio")


_CNT = "cnt as (select cast(floor(epoch(ts)/3600) as bigint) as bin, count(*) as cars from events where event_type = 'error' group by 1)"


@register("j16_attach_counts", f"with {B60}, {_CNT} select route, bins.bin, round(y,6) as y, cars from bins left join cnt on cnt.bin = bins.bin where route <> 'error'")
def j16(spark, d):
    """Each series' bins with the counts of the same bin."""
    e = raw(spark, d).filter("event_type = 'error'")
    cars = e.groupBy(F.floor(F.col("t") / 3600).cast("long").alias("bin")).agg(F.count("*").alias("cars"))
    return rounded(joins.attached(hourly(spark, d).filter("route <> 'error'").select("route", "bin", "y"), cars, ["bin"]), "y")


@register("j17_transplant", f"with {TIMED} select a.bin, round(a.y_persistence,6) as y_persistence, round(b.y_30,6) as y_30 from timed a left join timed b on b.route = 'view' and b.bin = a.bin where a.route = 'click'")
def j17(spark, d):
    """One feed's features under the other feed's label."""
    t = timed(spark, d)
    features = t.filter("route = 'click'").select("bin", "y_persistence", "y_30")
    return rounded(joins.transplanted(features, t.filter("route = 'view'").select("bin", "y_30"), ["bin"], "y_30"), "y_persistence", "y_30")


@register("w24_latest_fresh", "with e as (select user_id, event_type, cast(floor(epoch(ts)) as bigint) as t, value, event_id from events), m as (select cast(floor(epoch(max(ts))) as bigint) as now from events), l as (select user_id, max(t) as t, arg_max(value, t*1000000 + event_id) as value from e group by 1) select user_id, now - t as age, round(case when now - t <= 43200 then value end,6) as value from l, m")
def w24(spark, d):
    """The newest reading of each key, null if it is stale."""
    from ..operators.asof import latest_fresh

    e = raw(spark, d)
    return rounded(latest_fresh(e, "user_id", "t", "value", e.agg(F.max("t").alias("t")).first().t, 43200, "event_id"), "value")


@register("w28_servable", f"with {GAPS}, m as (select cast(floor(max(epoch(ts))) as bigint) as now from events), l as (select route, max(bin) as bin from ag group by 1) select l.route, l.bin, round(a.y,6) as y, cast(now - l.bin*600 - 600 <= 7200 and a.after_gap = 0 as bigint) as servable from l join ag a on a.route = l.route and a.bin = l.bin, m")
def w28(spark, d):
    """The newest bin of each series, and whether a forecast may start from it: fresh, and not after a gap."""
    from ..operators.serving import servable_origins

    b = bins.with_after_gap(bins.with_gap(ten_minutes(spark, d)))
    now = raw(spark, d).agg(F.max("t").alias("t")).first().t
    return rounded(servable_origins(b, now, 7200).select("route", "bin", "y", F.col("servable").cast("long").alias("servable")), "y")


@register("ax2_two_rows", "select event_id, 'A' as direction, cast(user_id as bigint) as own, cast(event_id % 50 as bigint) as other, cast(case when value < 20 then 0 when value < 40 then 1 else 2 end as bigint) as ordinal from events union all select event_id, 'B', event_id % 50, user_id, case when value < 20 then 0 when value < 40 then 1 else 2 end from events")
def ax2(spark, d):
    e = events(spark, d).select("event_id", F.col("user_id").alias("a"), (F.col("event_id") % 50).alias("b"), F.when(F.col("value") < 20, "low").when(F.col("value") < 40, "moderate").otherwise("high").alias("level"))
    out = rows.per_direction(e, {"low": 0, "moderate": 1, "high": 2})
    return out.select("event_id", "direction", "own", "other", F.col("ordinal").cast("long").alias("ordinal"))


@register("ax4_sampling_plan", "with d as (select distinct cast(floor((epoch(ts)+28800)/86400) as bigint) as local_day from events), m as (select local_day, minute, (minute >= 360 and minute < 660) or (minute >= 960 and minute < 1320) as p from d, (select unnest(range(0, 1440, 10)) as minute)) select local_day, cast(minute as bigint) as minute, row_number() over (partition by local_day order by p desc, minute) as rank from m where p or minute % 20 = 0")
def ax4(spark, d):
    days = raw(spark, d).select(F.floor((F.col("t") + 28800) / 86400).cast("long").alias("local_day")).distinct()
    return rows.sampling_plan(days).select("local_day", F.col("minute").cast("long").alias("minute"), F.col("rank").cast("long").alias("rank"))


@register("ax11_on_grid", "with e as (select event_type as route, cast(floor(epoch(ts)/60)*60 as bigint) as t, value - 3 as value from events) select route, cast(t/600 as bigint) as bin, round(value,6) as y from e where route in ('click', 'view') and value > 0 and t % 600 = 0")
def ax11(spark, d):
    e = raw(spark, d).select(F.col("event_type").alias("route"), (F.floor(F.col("t") / 60) * 60).cast("long").alias("t"), (F.col("value") - 3).alias("value"))
    return rounded(rows.on_grid(e, ["click", "view"]), "y")


@register("u2_concat_folds", f"with {B10} select 'early' as part, route, bin, round(y,6) as y from bins where bin*600 < 1705276800 union all select 'late', route, bin, round(y,6) from bins where bin*600 >= 1705276800 - 86400")
def u2(spark, d):
    """Parts that overlap, one after another."""
    b = ten_minutes(spark, d).select("route", "bin", "y")
    early, late = b.filter(F.col("bin") * 600 < 1705276800), b.filter(F.col("bin") * 600 >= 1705276800 - 86400)
    return rounded(early.select(F.lit("early").alias("part"), "*").unionByName(late.select(F.lit("late").alias("part"), "*")), "y")


@register("u4_common_keys", f"with {B60} select bin from bins where route = 'click' intersect select bin from bins where route = 'view'")
def u4(spark, d):
    b = hourly(spark, d)
    return b.filter("route = 'click'").select("bin").intersect(b.filter("route = 'view'").select("bin"))


@register("o3_top_rules", "with t as (select user_id, event_type, count(*) as support from events group by 1, 2) select user_id, event_type, support from t order by support desc, user_id, event_type limit 25")
def o3(spark, d):
    """The 25 combinations of most support: the query is a top-k report."""
    t = raw(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("support"))
    return t.orderBy(F.desc("support"), "user_id", "event_type").limit(25)


@register("o5_top_candidates", "with k as (select l_orderkey as frame, l_linenumber, l_discount, row_number() over (partition by l_orderkey order by l_discount desc, l_linenumber) as k from lineitem where l_discount >= 0.03) select frame, cast(l_linenumber as bigint) as id, cast(k as bigint) as k from k where k <= 3")
def o5(spark, d):
    """Each frame's three boxes of highest score above a floor, as candidates for suppression."""
    line = spark.read.parquet(f"{d}/lineitem.parquet").filter("l_discount >= 0.03")
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_discount"), "l_linenumber")
    return line.withColumn("k", F.row_number().over(w)).filter("k <= 3").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").cast("long").alias("id"), F.col("k").cast("long").alias("k"))
