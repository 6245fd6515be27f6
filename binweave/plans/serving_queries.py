"""Queries of horizons, folds, splits, serving decisions, registry and payload rules, with independent SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import bins, calendar, horizons, lags, models, seasonal, serving
from .catalog import register
from .score_queries import OVERLAP, greedy, unique_boxes
from .series_queries import _HGRID, B10, TIMED, events, hourly_grid, raw, rounded, ten_minutes, timed
from .table_queries import _CAL, SCORED, scored

_DAY = "cast(floor((bin*600+28800)/86400) as bigint)"


@register(
    "m6_rolling_ridge",
    f"with {SCORED}, x as (select route, bin, y_30 as y, y_persistence as v, {_DAY} as day, cast(floor((bin*600 + 2400 + 28800 + 86399)/86400) as bigint) as known from sl), s as (select route, known, count(*) as n, sum(v) as sv, sum(v*v) as svv, sum(y) as sy, sum(v*y) as svy from x group by 1, 2), d as (select distinct route, day from x), f as (select d.route, d.day, sum(n) as n, sum(sv)/sum(n) as mv, sum(svv) - sum(sv)*sum(sv)/sum(n) as cvv, sum(sy)/sum(n) as my, sum(svy) - sum(sv)*sum(sy)/sum(n) as cvy from d join s on s.route = d.route and s.known <= d.day group by 1, 2), w as (select *, case when cvv > 0 then (cvy/sqrt(cvv/n))/(cvv/(cvv/n) + 1.0)/sqrt(cvv/n) else 0 end as w from f where n >= 20) select x.route, x.bin, round(my + w*(v - mv),5) as ridge from x left join w on w.route = x.route and w.day = x.day",
)
def m6_ridge(spark, d):
    """A ridge per series refitted for every day on the labels known by then."""
    return rounded(horizons.rolling_ridge(scored(spark, d), ["y_persistence"], "y_30", "route", least=20).select("route", "bin", "ridge"), "ridge", digits=5)


_HZ = " union all ".join(f"select {h}*60 as minutes, a.route, a.bin, b.y as label, a.y as persistence, d1.y as d1, d7.y as d7 from grid a join grid b on b.route = a.route and b.bin = a.bin + {h} and b.y is not null left join grid d1 on d1.route = a.route and d1.bin = a.bin + {h} - 24 left join grid d7 on d7.route = a.route and d7.bin = a.bin + {h} - 168" for h in (1, 3, 24))


@register("m7_horizons", f"with {_HGRID}, h as ({_HZ}) select minutes, count(*) as n, round(avg(abs(persistence - label)),6) as persistence, round(avg(abs(d1 - label)),6) as d1, round(avg(abs(d7 - label)),6) as d7 from h group by 1")
def m7(spark, d):
    """Naive forecasts at several horizons: here hours, as the bins are hourly."""
    g = hourly_grid(spark, d)
    at = lambda k: lags.at_offset("y", k)
    out = None
    for h in (1, 3, 24):
        rows = g.withColumns({"label": at(h), "persistence": F.col("y"), "d1": at(h - 24), "d7": at(h - 168)}).filter("label is not null").withColumn("minutes", F.lit(h * 60))
        out = rows if out is None else out.unionByName(rows)
    err = lambda c: F.avg(F.abs(F.col(c) - F.col("label"))).alias(c)
    return rounded(out.groupBy("minutes").agg(F.count("*").alias("n"), err("persistence"), err("d1"), err("d7")), "persistence", "d1", "d7")


@register("m7_horizon_rows", f"with {B10} select a.route, a.bin, round(b.y,6) as label, round(a.y,6) as persistence, round(d1.y,6) as d1, round(d7.y,6) as d7 from bins a join bins b on b.route = a.route and b.bin = a.bin + 12 left join bins d1 on d1.route = a.route and d1.bin = a.bin + 12 - 144 left join bins d7 on d7.route = a.route and d7.bin = a.bin + 12 - 1008")
def m7_rows(spark, d):
    """Labels two hours ahead on ten-minute bins, with the naive forecasts of them."""
    return rounded(horizons.horizon_rows(ten_minutes(spark, d), 120).select("route", "bin", "label", "persistence", "d1", "d7"), "label", "persistence", "d1", "d7")


_HP = f"{SCORED}, pf as (select route, cast(floor(((bin*600+28800) % 86400)/3600) as bigint) as slot, avg(y_30) as p from sl group by 1, 2)"


def hourly_profile(spark, d) -> DataFrame:
    """The mean label of each series and local hour."""
    s = scored(spark, d)
    return s.groupBy("route", F.floor(F.col("tod_min") / 60).cast("long").alias("slot")).agg(F.avg("y_30").alias("profile"))


@register("m11_profile_deltas", f"with {_HP} select sl.route, sl.bin, round(a.p,9) as profile_now, round(b.p,9) as profile_ahead, round(b.p - a.p,9) as profile_delta from sl left join pf a on a.route = sl.route and a.slot = cast(floor(((sl.bin*600+28800) % 86400)/3600) as bigint) left join pf b on b.route = sl.route and b.slot = cast(floor(((sl.bin*600+1800+28800) % 86400)/3600) as bigint)")
def m11(spark, d):
    out = serving.with_profile_deltas(scored(spark, d).select("route", "bin"), hourly_profile(spark, d))
    return rounded(out, "profile_now", "profile_ahead", "profile_delta", digits=9)


@register("m16_served_model", f"with {SCORED}, r(route, model) as (values ('click','p1'),('view','y_persistence'),('error','p1')) select sl.route, sl.bin, r.model, round(case r.model when 'p1' then p1 else y_persistence end,6) as served from sl join r on r.route = sl.route")
def m16(spark, d):
    """Each series' prediction by the model that the registry serves for it."""
    registry = spark.createDataFrame([("click", "p1"), ("view", "y_persistence"), ("error", "p1")], "route string, model string")
    s = scored(spark, d).join(F.broadcast(registry), "route")  # one row per series
    return rounded(s.select("route", "bin", "model", F.when(F.col("model") == "p1", F.col("p1")).otherwise(F.col("y_persistence")).alias("served")), "served")


_SPLIT = f"{SCORED}, x as (select route, bin, y_30, {_DAY} as day from sl), d as (select day, (row_number() over (order by day) - 1)/(count(*) over ())::double as s from (select distinct day from x)), p as (select day, case when s < 0.6 then 1 when s < 0.7 then 2 when s < 0.85 then 3 else 4 end as r from d)"


@register("m21_split_days", f"with {_SPLIT} select x.route, x.bin, ['fit','inner','validation','test'][p.r] as part, round(case when q.r <= p.r then y_30 end,6) as y_30 from x join p on p.day = x.day left join p q on q.day = cast(floor((x.bin*600 + 1800 + 28800)/86400) as bigint)")
def m21(spark, d):
    """Whole days to fit, inner, validation and test; labels that reach into a later part are masked."""
    s = horizons.split_days(scored(spark, d).select("route", "bin", "y_30", "local_day"))
    return rounded(horizons.boundary_masked(s, "y_30", 3).select("route", "bin", "part", "y_30"), "y_30")


@register("m22_split", f"with {B10}, t as (select distinct bin from bins), k as (select bin, row_number() over (order by bin) as k, count(*) over () as n from t) select route, b.bin, case when k.k <= floor(k.n*0.8) then 'train' else 'test' end as part from bins b join k on k.bin = b.bin")
def m22(spark, d):
    return horizons.chronological_split(ten_minutes(spark, d), ["bin"], 0.8).select("route", "bin", "part")


@register("m22_backtest_days", f"with {_HGRID} select route, cast(floor((bin*3600+28800)/86400) as bigint) as local_day, count(y) as n from grid where y is not null group by 1, 2 having count(*) >= 0.9*24")
def m22_days(spark, d):
    return horizons.backtest_days(hourly_grid(spark, d), 0.9, 24).select("route", "local_day", "n")


_M23 = f"{_HGRID}, t as (select a.route, a.bin, avg(b.y) as tod from grid a left join grid b on b.route = a.route and b.bin % 24 = a.bin % 24 and b.bin between a.bin - 168 and a.bin - 1 group by 1, 2), m as (select g.route, floor((g.bin*3600+28800)/86400) as day, l.y as label, g.y as persistence, d1.y as d1, d7.y as d7, t.tod, 0.7*d1.y + 0.3*d7.y as blend from grid g join grid l on l.route = g.route and l.bin = g.bin + 3 left join grid d1 on d1.route = g.route and d1.bin = g.bin - 21 left join grid d7 on d7.route = g.route and d7.bin = g.bin - 165 join t on t.route = g.route and t.bin = g.bin + 3)"


@register("m23_day_backtest", f"with {_M23}, c as (select * from m where label is not null and persistence is not null and d1 is not null and d7 is not null and tod is not null) select route, cast(day as bigint) as local_day, method, count(*) as n, round(avg(abs(p - label)),6) as mae from c unpivot (p for method in (persistence, d1, d7, tod, blend)) group by 1, 2, 3")
def m23(spark, d):
    """Five methods three hours ahead on identical rows, by day."""
    g = seasonal.same_time_mean(hourly_grid(spark, d), 24)
    at = lambda c, k: lags.at_offset(c, k)
    rows = g.withColumns({"label": at("y", 3), "persistence": F.col("y"), "d1": at("y", -21), "d7": at("y", -165), "tod3": at("tod", 3)}).drop("tod").withColumnRenamed("tod3", "tod")
    rows = rows.withColumns({"blend": 0.7 * F.col("d1") + 0.3 * F.col("d7"), "local_day": F.floor((F.col("bin") * 3600 + 28800) / 86400).cast("long")})
    return rounded(horizons.day_backtest(rows, ["persistence", "d1", "d7", "tod", "blend"], "label", "route", "local_day"), "mae")


@register("m24_ablation")
def m24(spark, d):
    """Ridges on three sets of features, fitted on the first days and tested on the last; held against NumPy in the tests."""
    s = horizons.split_days(scored(spark, d)).withColumn("part", F.when(F.col("part") == "test", "test").otherwise("train"))
    sets = {"A": ["y_persistence"], "B": ["y_persistence", "tod_sin", "tod_cos"], "C": ["y_persistence", "tod_sin", "tod_cos", "is_weekend", "is_morning_peak"]}
    return horizons.ablation(s, sets, "y_30", "route")


_RULES = "sc as (select event_type as route, cast(hour(ts) % 3 as bigint) as step, avg(value) as mae, avg(value) filter (event_id % 2 = 0) as persistence_mae, avg(value) filter (event_id % 3 = 0) as fallback_mae, avg(value) filter (event_id % 5 = 0) as counts_mae, avg(value) filter (event_id % 7 = 0) as counts_twin_mae, avg((value > 20)::int) as coverage from events group by 1, 2), dr as (select *, coalesce(coverage >= 0.5 and counts_mae < counts_twin_mae and counts_mae < fallback_mae, false) as use_counts from sc), rules as (select *, case when coalesce(case when use_counts then counts_mae else mae end < persistence_mae, false) then case when use_counts then 'counts' else 'model' end else 'persistence' end as serve from dr)"


def rule_scores(spark, d) -> DataFrame:
    """Stand-in scores of each series and step: means of different parts of the events."""
    v, i = F.col("value"), F.col("event_id")
    part = lambda k: F.avg(F.when(i % k == 0, v))
    e = raw(spark, d).withColumns({"route": F.col("event_type"), "step": F.floor(F.col("t") / 3600) % 24 % 3})
    return e.groupBy("route", F.col("step").cast("long").alias("step")).agg(F.avg(v).alias("mae"), part(2).alias("persistence_mae"), part(3).alias("fallback_mae"), part(5).alias("counts_mae"), part(7).alias("counts_twin_mae"), F.avg((v > 20).cast("double")).alias("coverage"))


@register("r1_decision_rules", f"with {_RULES} select route, step, use_counts, serve from rules")
def r1(spark, d):
    return serving.decision_rules(rule_scores(spark, d)).select("route", "step", "use_counts", "serve")


@register("r2_by_decision", f"with {TIMED}, {_RULES} select t.route, t.bin, round(case serve when 'counts' then coalesce(lag_60, roll_mean_30, y_persistence) when 'model' then coalesce(roll_mean_30, y_persistence) else y_persistence end,6) as served, case serve when 'counts' then case when lag_60 is not null then 'lag_60' when roll_mean_30 is not null then 'roll_mean_30' else 'y_persistence' end when 'model' then case when roll_mean_30 is not null then 'roll_mean_30' else 'y_persistence' end else 'y_persistence' end as served_by from timed t join rules on rules.route = t.route and rules.step = 0")
def r2_rules(spark, d):
    """The fallback chain that each series' decision names."""
    chains = {"counts": ["lag_60", "roll_mean_30", "y_persistence"], "model": ["roll_mean_30", "y_persistence"], "persistence": ["y_persistence"]}
    rules = serving.decision_rules(rule_scores(spark, d)).filter("step = 0")
    return rounded(serving.served(timed(spark, d), rules, ["route"], chains).select("route", "bin", "served", "served_by"), "served")


_REG = "reg as (select cast(floor(epoch(ts)) as bigint)*1000 + event_id % 1000 as created_at, event_type as model, value, event_id from events)"


@register("r3_registry", f"with {_REG} select model, max(created_at) as created_at, round(arg_max(value, created_at*1.0),6) as weight, arg_max(event_id % 2 = 1, created_at*1.0) as drift, arg_max(case when event_id % 5 = 0 then 'persistence' end, created_at*1.0) as fallback from (select *, created_at from reg) where model in ('click', 'view', 'error') group by 1".replace("arg_max(case when event_id % 5 = 0 then 'persistence' end, created_at*1.0)", "case when arg_max(event_id % 5, created_at*1.0) = 0 then 'persistence' end").replace("round(arg_max(value, created_at*1.0),6)", "case when arg_max(event_id % 5, created_at*1.0) <> 0 then round(arg_max(value, created_at*1.0),6) end"))
def r3(spark, d):
    """Registry rows written as JSON and read back: the newest of each model, its drift of configuration, and persistence for an unreadable part."""
    e = raw(spark, d).withColumn("created_at", F.col("t") * 1000 + F.col("event_id") % 1000)
    config = F.when(F.col("event_id") % 2 == 1, '{"depth": 5}').otherwise('{"depth": 4}')
    parts = F.when(F.col("event_id") % 5 == 0, '{"weight": "?').otherwise(F.to_json(F.struct(F.col("value").alias("weight"))))
    registry = e.select("created_at", F.col("event_type").alias("model"), parts.alias("parts"), config.alias("config"))
    out = None
    for model in ("click", "view", "error"):
        own = serving.registry_read(registry, model, "weight double", {"depth": 4}).select("model", "created_at", F.round("parts.weight", 6).alias("weight"), "drift", "fallback")
        out = own if out is None else out.unionByName(own)
    return out


_CURVE = f"{_HP}, o as (select route, max(bin)*600 as origin_s, arg_max(y_persistence, bin) as model from timed group by 1), c as (select o.*, a.ahead, case when o.route = 'view' then null else model end as m from o, (select unnest(range(1800, 86401, 1800)) as ahead) a), pp as (select route, slot*2 + k as slot, p from pf, (select unnest([0, 1]) as k))"


@register("r4_forecast_curve", f"with {_CURVE} select c.route, cast(ahead as bigint) as ahead_s, cast(origin_s + ahead as bigint) as target_s, round(case when ahead <= 19800 and m is not null then m else p end,9) as value, case when ahead <= 19800 and m is not null then 'model' when p is not null then 'profile' end as source from c left join pp on pp.route = c.route and pp.slot = cast(floor(((origin_s + ahead + 28800) % 86400)/1800) as bigint)")
def r4(spark, d):
    """A day's curve from each series' newest origin: the model to 330 minutes, the profile after, the profile alone where the origin has no value."""
    origins = timed(spark, d).groupBy("route").agg((F.max("bin") * 600).alias("origin_s"), F.max_by("y_persistence", "bin").alias("model")).withColumn("model", F.when(F.col("route") != "view", F.col("model")))
    profile = hourly_profile(spark, d).select("route", F.explode(F.array(F.col("slot") * 2, F.col("slot") * 2 + 1)).alias("slot"), "profile")
    out = serving.forecast_curve(origins, profile)
    return rounded(out.select("route", F.col("ahead_s").cast("long").alias("ahead_s"), F.col("target_s").cast("long").alias("target_s"), "value", "source"), "value", digits=9)


@register("r5_profile_curve", "with k as (select distinct event_type as route from events) select route, cast(w as bigint) as is_weekend, cast(m as bigint) as tod_min, round(20 + 5*sin((m+5)*2*pi()/1440) + w*cos((m+5)*2*pi()/1440),6) as profile from k, (select unnest([0, 1]) as w), (select unnest(range(0, 1440, 10)) as m)")
def r5(spark, d):
    """A Fourier profile of given weights over a working and a weekend day."""
    keys = raw(spark, d).select(F.col("event_type").alias("route")).distinct()
    x = models.fourier(F.col("tod_min"), F.col("is_weekend"), 1)
    value = 20 + 5 * x[1] + x[4]
    out = serving.profile_curve(keys, value)
    return rounded(out.select("route", F.col("is_weekend").cast("long").alias("is_weekend"), F.col("tod_min").cast("long").alias("tod_min"), "profile"), "profile")


@register("r6_served_chain", f"with {_HP}, x as (select t.route, t.bin, case when lag_10 is not null and roll_mean_30 is not null then (lag_10 + roll_mean_30)/2 end as mix, roll_mean_30 as xgb, case when after_gap = 0 then y_persistence end as persistence, p from timed t left join pf on pf.route = t.route and pf.slot = cast(floor(((t.bin*600+28800) % 86400)/3600) as bigint)) select route, bin, round(coalesce(mix, xgb, persistence, p),6) as served, case when mix is not null then 'mix' when xgb is not null then 'xgb' when persistence is not null then 'persistence' when p is not null then 'profile' end as served_by from x")
def r6(spark, d):
    """The default chain: the mix of two members, one of them, persistence, the profile."""
    t = timed(spark, d).withColumn("slot", F.floor(F.pmod(F.col("bin") * 600 + 28800, F.lit(86400)) / 3600).cast("long")).join(F.broadcast(hourly_profile(spark, d)), ["route", "slot"], "left")
    both = F.col("lag_10").isNotNull() & F.col("roll_mean_30").isNotNull()
    t = t.withColumns({"mix": F.when(both, (F.col("lag_10") + F.col("roll_mean_30")) / 2), "xgb": F.col("roll_mean_30"), "persistence": F.when(F.col("after_gap") == 0, F.col("y_persistence"))})
    return rounded(models.fallback_chain(t, ["mix", "xgb", "persistence", "profile"]).select("route", "bin", "served", "served_by"), "served")


@register("r7_catalogue", "select * from (values ('mix', 'ready', 30, 'v2'), ('mix', 'ready', 60, 'v2'), ('persistence', 'ready', 30, 'v1'), ('deep', 'offline', 30, 'v0')) t(model, state, horizon, version)")
def r7(spark, d):
    return serving.catalogue(spark, [("mix", "ready", [30, 60], "v2"), ("persistence", "ready", [30], "v1"), ("deep", "offline", [30], "v0")])


@register("r8_cache_states", "with e as (select event_id, cast(floor(epoch(ts)) as bigint) as t from events), m as (select max(t) as now from e) select event_id, now - t as age_s, case when now - t <= 3600 then 'fresh' when now - t <= 86400 then 'stale' else 'expired' end as state from e, m")
def r8(spark, d):
    e = raw(spark, d).select("event_id", F.col("t").alias("stored_s"))
    return serving.cache_states(e, e.agg(F.max("stored_s").alias("t")).first().t, 3600, 86400).select("event_id", "age_s", "state")


@register("r9_blend_payloads", "with w as (select event_id, event_id % 5 as a, event_id % 4 as b from events) select event_id, case when a + b = 0 then 'empty' when a = 4 then 'name' when a*0.5 > 1 or b*0.25 > 1 then 'range' when abs(a*0.5 + b*0.25 - 1) > 1e-6 then 'sum' end as problem from w")
def r9(spark, d):
    """Blend weights of requests: which are no blend, and why."""
    a, b = F.col("event_id") % 5, F.col("event_id") % 4
    w = F.when(a + b == 0, F.create_map().cast("map<string,double>")).otherwise(F.create_map(F.when(a == 4, "other").otherwise("mix"), (a * 0.5).cast("double"), F.lit("xgb"), (b * 0.25).cast("double")))
    return events(spark, d).select("event_id", serving.blend_problem(w, ["mix", "xgb"]).alias("problem"))


@register("r11_regime_labels", f"with {SCORED}, m as (select route, bin, y_persistence, p1, greatest(0.0, least(1.0, (25 - y_persistence)/10)) as a, greatest(0.0, least(1.0, (y_persistence - 15)/10, (40 - y_persistence)/10)) as b, greatest(0.0, least(1.0, (y_persistence - 30)/10)) as c from sl) select route, bin, case when a >= b and a >= c then 'light' when b >= c then 'moderate' else 'heavy' end as origin_regime, case when p1 <= 20 then 'light' when p1 <= 35 then 'moderate' else 'heavy' end as forecast_regime from m")
def r11(spark, d):
    return scored(spark, d).select("route", "bin", serving.regime_label(F.col("y_persistence")).alias("origin_regime"), serving.regime_label(F.col("p1")).alias("forecast_regime"))


@register("st4_unexpired", "with e as (select event_id, cast(floor(epoch(ts)) as bigint) as t from events), m as (select max(t) as now from e) select event_id, t + 7200 as target_s from e, m where t + 7200 > now")
def st4(spark, d):
    e = raw(spark, d)
    return serving.unexpired(e.select("event_id", (F.col("t") + 7200).alias("target_s")), e.agg(F.max("t").alias("t")).first().t)


_PLAN = "p as (select *, row_number() over (order by bin) as k from (select distinct cast(floor(epoch(ts)/600) as bigint) as bin from events where event_type = 'error') where bin not in (select cast(floor(epoch(ts)/600) as bigint) from events where event_type = 'click'))"


@register("st7_backfill_plan", f"with {_PLAN} select bin, k from p where k <= 50")
def st7(spark, d):
    """What a resumable backfill would do next: bins not done yet, oldest first, within a budget of 50."""
    from ..streaming.backfill import plan

    b = raw(spark, d).withColumn("bin", F.floor(F.col("t") / 600).cast("long"))
    todo, done = b.filter("event_type = 'error'").select("bin").distinct(), b.filter("event_type = 'click'").select("bin")
    return plan(todo, done, ["bin"], 50)


@register("st8_day_states", "with e as (select cast(floor(epoch(ts)/86400) as bigint) as day, event_type from events), r as (select day, count(*) filter (event_type = 'click') as pages, count(*) filter (event_type = 'error') as failed, max(max(day)) over () as today from e group by 1) select day, case when day = today then 'skipped_today' when failed > pages then case when pages > 0 then 'partial' else 'failed' end when pages = 0 then 'no_data' when day % 7 = 0 then 'skipped' else 'fetched' end as state from r")
def st8(spark, d):
    from ..streaming.backfill import day_states

    e = raw(spark, d).withColumn("day", F.floor(F.col("t") / 86400).cast("long"))
    days = e.groupBy("day").agg(F.count_if(F.col("event_type") == "click").alias("pages"), F.count_if(F.col("event_type") == "error").alias("failed")).withColumn("present", F.col("day") % 7 == 0)
    return day_states(days, e.agg(F.max("day").alias("m")).first().m).select("day", "state")


@register("st9_task_share", "with k as (select user_id, row_number() over (order by user_id) - 1 as i from (select distinct user_id from events)) select user_id from k where i % 4 = 1")
def st9(spark, d):
    """The second of four tasks' share of a list of work."""
    from ..streaming.backfill import task_share

    return task_share(raw(spark, d).select("user_id").distinct(), ["user_id"], 1, 4)


@register("ax5_status", "with f as (select event_id, cast(floor(epoch(ts)) as bigint) as b, case when event_id % 4 <> 0 then cast(floor(epoch(ts)) as bigint) - event_id % 1200 end as fs, event_id % 9 as bytes, case when event_id % 6 = 0 then 'HTTP 429' when event_id % 6 = 3 then 'bad gateway' end as error from events) select event_id, case when fs is null then 'missing_frame' when b - fs > 900 then 'stale_frame' when bytes <= 0 then 'invalid_image' when error like '%429%' then 'quota' when error is not null then 'error' else 'ok' end as status from f")
def ax5(spark, d):
    i, t = F.col("event_id"), F.col("t")
    f = raw(spark, d).select("event_id", t.alias("bin_s"), F.when(i % 4 != 0, t - i % 1200).alias("frame_s"), (i % 9).alias("bytes"), F.when(i % 6 == 0, "HTTP 429").when(i % 6 == 3, "bad gateway").alias("error"))
    return serving.scoring_status(f).select("event_id", "status")


@register("ax6_light_slices", "with f as (select event_id, case when event_id % 5 <> 0 then cast(floor(epoch(ts)) as bigint) end as fs, case when event_id % 3 <> 0 then value end as lum from events), s as (select *, case when fs is not null then case when floor(((fs+28800) % 86400)/3600) between 7 and 18 then 'day' else 'night' end when lum is not null then case when lum < 60 then 'night' else 'day' end else 'unknown' end as light from f) select slice, count(*) as n, count(lum) as with_luminance from (select light as slice, lum from s union all select 'all', lum from s) group by 1")
def ax6(spark, d):
    f = raw(spark, d).select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("t")).alias("frame_s"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("luminance"))
    return serving.light_slices(f).groupBy("slice").agg(F.count("*").alias("n"), F.count("luminance").alias("with_luminance"))


@register("ax7_pool_means", f"with {TIMED} select route, bin, round((lag_10 + lag_20)/2,6) as replica, round((coalesce(lag_10*0.5,0) + coalesce(lag_20*0.3,0) + coalesce(y_persistence*0.2,0))/nullif((lag_10 is not null)::int*0.5 + (lag_20 is not null)::int*0.3 + (y_persistence is not null)::int*0.2,0),6) as blend, round(case when route = 'click' then (lag_10 + lag_20)/2 else y_persistence end,6) as served from timed where y_60 is not null")
def ax7(spark, d):
    """The replica pool an hour ahead: a mean, a weighted blend of those that exist, and the served column."""
    t = timed(spark, d).filter("y_60 is not null")
    mean = (F.col("lag_10") + F.col("lag_20")) / 2
    out = t.select("route", "bin", mean.alias("replica"), serving.blended(t, {"lag_10": 0.5, "lag_20": 0.3, "y_persistence": 0.2}).alias("blend"), F.when(F.col("route") == "click", mean).otherwise(F.col("y_persistence")).alias("served"))
    return rounded(out, "replica", "blend", "served")


@register("ax9_fuzzy_inputs", f"with {_HGRID} select g.route, cast(g.bin as bigint) as bin, round(g.y,6) as now, round(g.y - l7.y,6) as trend, cast(floor(((g.bin*600 + 1800 + 28800) % 86400)/3600) as bigint) as target_hour, round(coalesce(d1.y, g.y),6) as day_before from grid g left join grid l7 on l7.route = g.route and l7.bin = g.bin - 6 left join grid d1 on d1.route = g.route and d1.bin = g.bin - 24 where g.y is not null")
def ax9(spark, d):
    g = hourly_grid(spark, d).withColumns({"lag_1": F.col("y"), "lag_7": lags.at_offset("y", -6), "d1": lags.at_offset("y", -24)}).filter("y is not null")
    return rounded(serving.fuzzy_inputs(g).select("route", "bin", "now", "trend", "target_hour", "day_before"), "now", "trend", "day_before")


@register("ax9_majority", "with c as (select user_id, case when value < 20 then 1 when value < 35 then 2 else 3 end as k, count(*) as c from events group by 1, 2) select user_id, ['light','moderate','heavy'][arg_max(k, c*10 - k)] as majority from c group by 1")
def ax9_majority(spark, d):
    v = F.col("value")
    return serving.majority(raw(spark, d).withColumn("level", F.when(v < 20, "light").when(v < 35, "moderate").otherwise("heavy")), "user_id", "level", ["light", "moderate", "heavy"])


@register("ax10_covered", f"with {SCORED}, y as (select sl.*, t.lag_20 from sl join timed t on t.route = sl.route and t.bin = sl.bin) select route, count(*) as n, round(avg(abs(y_30 - p1)),6) as mae_all, round(avg(abs(y_30 - p1)) filter (lag_20 is not null),6) as mae_covered, round(avg((lag_20 is not null)::int),6) as coverage, avg((lag_20 is not null)::int) >= 0.6 as sufficient from y group by 1")
def ax10(spark, d):
    out = serving.covered_metrics(scored(spark, d), "route", "y_30", "p1", F.col("lag_20").isNotNull())
    return rounded(out, "mae_all", "mae_covered", "coverage")


@register("ax14_predicted_at", f"with {TIMED} select route, bin, round(case when after_gap = 0 and lag_10 is not null and lag_20 is not null then lag_10 end,6) as lag_10, round(case when after_gap = 0 and lag_10 is not null and lag_20 is not null then lag_20 end,6) as lag_20 from timed")
def ax14(spark, d):
    return rounded(serving.predicted_at(timed(spark, d), "lag_10", "lag_20").select("route", "bin", "lag_10", "lag_20"), "lag_10", "lag_20")


@register("ax19_nested_predictions", "select l_orderkey, cast(l_linenumber as bigint) as id, l_returnflag as class, round(l_discount,6) as confidence from lineitem")
def ax19(spark, d):
    """Boxes wrapped in replies of three shapes, and found again wherever they stand."""
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    one = F.to_json(F.array(F.struct(F.col("l_returnflag").alias("class"), F.col("l_discount").alias("confidence"), F.lit(1.0).alias("x"))))
    wrap = lambda a, b: F.concat(F.lit(a), one, F.lit(b))
    reply = F.when(F.col("l_linenumber") % 3 == 0, wrap('{"predictions":', "}")).when(F.col("l_linenumber") % 3 == 1, wrap('{"outputs":[{"predictions":{"image":{},"predictions":', "}}]}")).otherwise(wrap('{"result":{"time":1,"predictions":', "}}"))
    out = serving.nested_predictions(line.select("l_orderkey", F.col("l_linenumber").cast("long").alias("id"), reply.alias("reply")), "reply")
    return rounded(out.select("l_orderkey", "id", "class", "confidence"), "confidence")


@register("ax20_renamed", "select event_id, case event_type when 'click' then 'S01' when 'view' then 'S02' else event_type end as station from events")
def ax20(spark, d):
    e = events(spark, d).select("event_id", F.col("event_type").alias("station"))
    return serving.renamed_stations(serving.require_no_duplicates(e, ["event_id"]), {"click": "S01", "view": "S02"})


@register("ax23_scaled_tail", f"with {_HGRID}, o as (select *, row_number() over (partition by route order by bin) as r, count(*) over (partition by route) as n from grid where y is not null), p as (select *, case when r > n - floor(n*0.15) then 'val' else 'train' end as part from o), s as (select avg(y) as m, stddev_pop(y) as sd from p where part = 'train') select route, cast(bin as bigint) as bin, part, round((y - m)/sd,5) as y from p, s")
def ax23(spark, d):
    """The last 15 % of each series for validation; scaled by the training part alone."""
    rows = serving.validation_tail(hourly_grid(spark, d).filter("y is not null"), ["bin"])
    return rounded(serving.scaled(rows, rows.filter("part = 'train'"), ["y"]).select("route", "bin", "part", "y"), "y", digits=5)


@register("ax26_day_comparison", "with p as (select event_type as route, cast(floor(epoch(ts)) as bigint) as t, value, event_id % 4 = 0 as profile from events), s as (select route, cast(floor(t/300.0 + 0.5) as bigint) as slot, avg(value) as y from p where not profile group by 1, 2) select a.route, a.slot, round(a.y,6) as y, round(b.y,6) as y_before, round(a.y - b.y,6) as change from s a left join s b on b.route = a.route and b.slot = a.slot - 288")
def ax26(spark, d):
    e = raw(spark, d).select(F.col("event_type").alias("route"), "t", F.col("value").alias("y"), F.when(F.col("event_id") % 4 == 0, "profile").alias("source"))
    return rounded(serving.day_comparison(e), "y", "y_before", "change")


@register("f2_differences", "select event_id, date_sub('minute', timestamp '2024-01-03 00:00:00', ts) as minutes, cast(floor(epoch(ts + interval 90 seconds)) as bigint) as later, cast(floor(epoch(ts - interval 2 hours)) as bigint) as earlier from events")
def f2(spark, d):
    """Whole minutes since an instant, cut towards zero, and times moved by intervals."""
    e = events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", F.timestamp_diff("MINUTE", F.lit("2024-01-03 00:00:00").cast("timestamp"), "ts").alias("minutes"), F.unix_seconds(F.col("ts") + F.expr("interval 90 seconds")).alias("later"), F.unix_seconds(F.col("ts") - F.expr("interval 2 hours")).alias("earlier"))


@register("f3_zones", "select event_id, strftime(ts + interval 8 hours, '%Y-%m-%d %H:%M:%S') as local_time, strftime(ts - interval 8 hours, '%Y-%m-%d %H:%M:%S') as from_local, cast(date_trunc('hour', ts + interval 8 hours) as varchar) as local_hour, cast(cast(ts + interval 8 hours as date) as varchar) as local_date from events")
def f3(spark, d):
    ts = F.col("ts").cast("timestamp")
    local = F.from_utc_timestamp(ts, "Asia/Singapore")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return events(spark, d).select("event_id", text(local).alias("local_time"), text(F.to_utc_timestamp(ts, "Asia/Singapore")).alias("from_local"), text(F.date_trunc("HOUR", local)).alias("local_hour"), F.date_format(local, "yyyy-MM-dd").alias("local_date"))


@register("f4_extract", "select event_id, cast(hour(ts) as bigint) as hour, cast(minute(ts) as bigint) as minute, cast(dayofweek(ts) + 1 as bigint) as dow from events")
def f4(spark, d):
    return events(spark, d).select("event_id", F.hour("ts").cast("long").alias("hour"), F.minute("ts").cast("long").alias("minute"), F.dayofweek("ts").cast("long").alias("dow"))


@register("f5_formats", "select event_id, strftime(ts, '%Y%m%dT%H%M') as stamp, cast(floor(epoch(strptime(strftime(ts, '%Y/%m/%d %H:%M'), '%Y/%m/%d %H:%M'))) as bigint) as parsed from events")
def f5(spark, d):
    ts = F.col("ts").cast("timestamp")
    return events(spark, d).select("event_id", F.date_format(ts, "yyyyMMdd'T'HHmm").alias("stamp"), F.unix_seconds(F.to_timestamp(F.date_format(ts, "yyyy/MM/dd HH:mm"), "yyyy/MM/dd HH:mm")).alias("parsed"))


@register("f7_offset_iso", "select event_id, case when event_id % 3 <> 2 then strftime(date_trunc('second', ts) - case when event_id % 3 = 0 then interval 8 hours else interval 0 hours end, '%Y-%m-%dT%H:%M:%SZ') end as utc from events")
def f7(spark, d):
    """ISO times with an offset as UTC text; without one, null."""
    from ..functions.times import utc_iso

    ts = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.concat(ts, F.element_at(F.array(F.lit("+08:00"), F.lit("Z"), F.lit("")), (F.col("event_id") % 3).cast("int") + 1))
    return events(spark, d).select("event_id", utc_iso(text).alias("utc"))


@register("f6_parsed_times", "select event_id, case event_id % 6 when 5 then null else cast(floor(epoch(ts)) as bigint) - case when event_id % 6 in (0, 1) then 28800 else 0 end end as parsed from events")
def f6(spark, d):
    """Times written in six ways and read back: dashed and compact without offset (local), with Z, epoch seconds and milliseconds, and nonsense."""
    from ..sources.readers import instant

    ts, i = F.col("ts").cast("timestamp"), F.col("event_id") % 6
    text = F.when(i == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(i == 1, F.date_format(ts, "yyyyMMddHHmmss")).when(i == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i == 3, F.unix_seconds(ts).cast("string")).when(i == 4, F.concat(F.unix_seconds(ts).cast("string"), F.lit("000"))).otherwise(F.lit("no time"))
    return events(spark, d).select("event_id", F.unix_seconds(instant(text, "Asia/Singapore")).alias("parsed"))


@register("f9_day_bounds", "select event_id, cast(floor((floor(epoch(ts))+28800)/86400) as bigint) as local_day, cast(floor((floor(epoch(ts))+28800)/86400)*86400 - 28800 as bigint) as day_start, cast(floor(epoch(ts)/600)*600 - 600 as bigint) as last_complete from events")
def f9(spark, d):
    from ..functions.times import last_complete_bin, local_day, local_day_start

    t = bins.seconds("ts")
    return events(spark, d).select("event_id", local_day(t).alias("local_day"), local_day_start(local_day(t)).alias("day_start"), last_complete_bin(t).alias("last_complete"))


@register("f10_text", "select p_partkey, p_brand || '/' || p_type as joined, split_part(p_name, ' ', 2) as second, lower(p_brand) as lowered, starts_with(p_type, 'STANDARD') as standard, regexp_matches(p_name, '^[a-m]') as early, array_to_string(list_filter(list_transform(string_split(p_name || ' , x ,', ','), lambda s: trim(s)), lambda s: s <> ''), '|') as names from part")
def f10(spark, d):
    from ..functions.texts import split_names

    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("joined"), F.coalesce(F.try_element_at(F.split("p_name", " "), F.lit(2)), F.lit("")).alias("second"), F.lower("p_brand").alias("lowered"), F.startswith("p_type", F.lit("STANDARD")).alias("standard"), F.col("p_name").rlike("^[a-m]").alias("early"), F.array_join(split_names(F.concat("p_name", F.lit(" , x ,"))), "|").alias("names"))


@register("f11_conditionals", "select event_id, case when value > 20 then 1 else 0 end as high, coalesce(nullif(event_type, 'error'), 'none') as kind, round(value / nullif(user_id % 3, 0),6) as safe, value between 10 and 20 as between_, event_type in ('click', 'view') as listed from events")
def f11(spark, d):
    v = F.col("value")
    out = events(spark, d).select("event_id", F.when(v > 20, 1).otherwise(0).alias("high"), F.coalesce(F.nullif(F.col("event_type"), F.lit("error")), F.lit("none")).alias("kind"), F.try_divide(v, F.col("user_id") % 3).alias("safe"), v.between(10, 20).alias("between_"), F.col("event_type").isin("click", "view").alias("listed"))
    return rounded(out, "safe")


@register("f12_math", "select event_id, round(sin(value),6) as s, round(cos(value),6) as c, round(acos(-1),6) as pi_, abs(event_id - 500) as a, event_id % 7 as m, round_even(event_id / 2.0, 0) as even from events")
def f12(spark, d):
    v = F.col("value")
    out = events(spark, d).select("event_id", F.sin(v).alias("s"), F.cos(v).alias("c"), F.acos(F.lit(-1.0)).alias("pi_"), F.abs(F.col("event_id") - 500).alias("a"), (F.col("event_id") % 7).alias("m"), F.bround(F.col("event_id") / 2, 0).alias("even"))
    return rounded(out, "s", "c", "pi_")


@register("f14_json_numbers", "select event_id, round(case when event_id % 5 in (0, 1) then null else value end,6) as value, json_extract_string(props, '$.k') as k from events")
def f14(spark, d):
    """Numbers through JSON and back: NaN and infinities become null."""
    from ..functions.texts import json_number

    v = F.when(F.col("event_id") % 5 == 0, float("nan")).when(F.col("event_id") % 5 == 1, float("inf")).otherwise(F.col("value"))
    text = F.to_json(F.struct(json_number(v).alias("value")))
    e = spark.read.parquet(f"{d}/events.parquet")
    return rounded(e.select("event_id", F.get_json_object(text, "$.value").cast("double").alias("value"), F.get_json_object("props", "$.k").alias("k")), "value")


@register("f15_eight_digits", "select event_id, cast(printf('%.7e', value * 1234.56789) as double) as canonical from events")
def f15(spark, d):
    from ..functions.texts import significant

    return events(spark, d).select("event_id", significant(F.col("value") * 1234.56789).alias("canonical"))


@register("f16_sha256", "select event_id, sha256(event_type || '/' || event_id) as sha256 from events")
def f16(spark, d):
    return events(spark, d).select("event_id", F.sha2(F.concat_ws("/", "event_type", F.col("event_id").cast("string")).cast("binary"), 256).alias("sha256"))


_PAGES = "with l as (select l_orderkey, l_linenumber, l_suppkey, l_quantity from lineitem)"


@register("s13_pages", f"{_PAGES} select l_orderkey as t, l_suppkey % 50 as station, round(cast(l_quantity as double),6) as value from l")
def s13_pages(spark, d):
    """Readings packed into one JSON page an order, and unfolded again from the text."""
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    page = line.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(F.struct((F.col("l_suppkey") % 50).alias("station"), F.col("l_quantity").cast("double").alias("value"))).alias("readings"))).alias("page"))
    r = page.select(F.col("l_orderkey").alias("t"), F.explode(F.from_json("page", "readings array<struct<station:bigint,value:double>>")["readings"]).alias("r"))
    return rounded(r.select("t", "r.station", "r.value"), "value")


@register("s13_stations", f"{_PAGES} select l_suppkey % 50 as station, arg_max(l_quantity::double, l_orderkey*10 + l_linenumber) as name from l group by 1")
def s13_stations(spark, d):
    """Stations of all pages, of one id the last by page and place."""
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    return line.groupBy((F.col("l_suppkey") % 50).alias("station")).agg(F.max_by(F.col("l_quantity").cast("double"), F.struct("l_orderkey", "l_linenumber")).alias("name"))


@register("s14_forecast_pages", "with f as (select o_orderkey % 1000 as issue, o_orderpriority as area, o_orderstatus as text, o_orderkey % 2 as coded from orders) select distinct issue, area, text from f")
def s14(spark, d):
    """Issues of area forecasts, whose text may be a string or an object with one, unfolded twice and made distinct."""
    from ..sources.readers import forecast_pages

    o = spark.read.parquet(f"{d}/orders.parquet")
    text = F.when(F.col("o_orderkey") % 2 == 1, F.to_json(F.struct(F.lit("C").alias("code"), F.col("o_orderstatus").alias("text")))).otherwise(F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('"')))
    entry = F.concat(F.lit('{"area":"'), F.col("o_orderpriority"), F.lit('","forecast":'), text, F.lit("}"))
    pages = o.groupBy((F.col("o_orderkey") % 1000).alias("issue")).agg(F.concat(F.lit('{"items":[{"forecasts":['), F.array_join(F.collect_list(entry), ","), F.lit("]}]}")).alias("page"))
    return forecast_pages(pages, "page").select("issue", "area", "text").distinct()


@register("v5_rescaled", "with b as (select l_orderkey*10 + l_linenumber as id, (l_partkey % 40)*1.0::double as x, (l_suppkey % 30)*1.0::double as y, 8.0::double + l_linenumber as h from lineitem), k as (select id, x, y + h/2 as f from b) select id, case when x < 2.5 or x > 17.5 then 'Unknown' when f < case when x <= 10 then 20 + (x-2.5)*20/7.5 else 40 - (x-10)*10/7.5 end then 'A' else 'B' end as direction from k")
def v5_rescaled(spark, d):
    """The dividing line scaled from its own picture size to the frames'."""
    from ..operators import detect
    from .model_queries import boxes

    line = detect.rescaled([(5, 10), (20, 20), (35, 15)], (40, 30), (20, 60))
    return detect.directed(boxes(spark, d), line).select("id", "direction")


@register("v2_decoded", "with s as (select l_orderkey as frame, cast(l_linenumber as bigint)*1000000000 + l_partkey*10000 + l_suppkey as anchor, l_discount, l_tax, l_quantity/50.0 as q from lineitem), k as (select frame, anchor, greatest(l_discount, l_tax*1.5, q*0.05) as score, case when l_discount >= l_tax*1.5 and l_discount >= q*0.05 then 0 when l_tax*1.5 >= q*0.05 then 1 else 2 end as cls from s), r as (select *, row_number() over (partition by frame order by score desc, anchor) as rn from k where score >= 0.04) select frame, anchor, cast(cls as bigint) as cls, round(score,6) as score from r where rn <= 4")
def v2(spark, d):
    """Rows of class scores decoded: the best class, a floor, and the best rows of a frame."""
    from ..operators import detect

    line = spark.read.parquet(f"{d}/lineitem.parquet")
    s = line.select(F.col("l_orderkey").alias("frame"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("anchor"), F.array(F.col("l_discount").cast("double"), F.col("l_tax").cast("double") * 1.5, F.col("l_quantity").cast("double") / 50.0 * 0.05).alias("scores"))
    return rounded(detect.decoded(s, 0.04, 4).select("frame", "anchor", F.col("cls").cast("long").alias("cls"), "score"), "score")


@register("v8_frame_plan", "with f as (select event_id, user_id % 5 as camera, cast(floor(epoch(ts)/600)*600 as bigint) as stamp from events where event_id % 9 <> 0), w as (select * from f where stamp >= 1704672000 and stamp < 1705536000) select camera, stamp, min(event_id) as event_id from w group by 1, 2")
def v8(spark, d):
    """The frames of a window, one per camera and capture time: the first name wins; unparsed names are left out."""
    from ..operators import detect

    e = raw(spark, d).select("event_id", (F.col("user_id") % 5).alias("camera"), F.when(F.col("event_id") % 9 != 0, F.floor(F.col("t") / 600) * 600).cast("long").alias("stamp"))
    plan, _ = detect.frame_plan(e, "camera", "stamp", "event_id", 1704672000, 1705536000)
    return plan


_KEPT_DIR = "u as (select frame, unnest(kept) as q from (select frame, arg_max(kept, k) as kept from r group by 1)), k as (select frame, q.y as y, q.h as h, case when q.x < 5 or q.x > 35 then 'Unknown' when q.y + q.h/2 < case when q.x <= 20 then 10 + (q.x-5)*10.0/15 else 20 - (q.x-20)*5.0/15 end then 'A' else 'B' end as dir from u)"


@register("ax18_frame_pipeline", f"{greedy(OVERLAP, 0.02, 'confidence desc, w*h desc, id')}, {_KEPT_DIR} select frame, count(*) as total, count(*) filter (dir='A') as a, count(*) filter (dir='B') as b, count(*) filter (dir='Unknown') as unknown, round(max(y+h/2) - min(y-h/2),4) as extent, case when count(*) < 20 then 'low' when count(*) < 40 then 'moderate' when count(*) < 71 then 'high' else 'severe' end as level from k group by 1")
def ax18(spark, d):
    """Confidence floor, overlap suppression, dividing line and summary of each frame, one after another."""
    from ..operators import detect

    kept = detect.suppressed(unique_boxes(spark, d).filter("confidence >= 0.02"), 0.6, by_class=False, smaller=True)
    return detect.frame_counts(detect.directed(kept, [(5, 10), (20, 20), (35, 15)]))


_RES = f"{SCORED}, r as (select route, bin, p1, p1 - y_persistence as x, y_30 - p1 as e from sl), m as (select route, count(*) as n, avg(x) as mx, stddev_pop(x) as sx, avg(e) as me, covar_pop(x, e) as c from r where route in ('click', 'view') group by 1), w as (select route, mx, me, case when sx > 0 then (n*c/sx)/(n + 1.0)/sx else 0 end as w from m)"


@register("ax16_residuals_applied", f"with {_RES} select r.route, bin, round(p1 + coalesce(me + w*(x - mx), 0),6) as calibrated, case when w.route is null then 'uncorrected' else 'corrected' end as status from r left join w on w.route = r.route")
def ax16(spark, d):
    """Residual corrections kept as a table of coefficients, applied by a join; series without one go uncorrected."""
    s = scored(spark, d)
    table = models.residual_table(s.filter("route in ('click', 'view')"), "p1", "y_persistence", "y_30", "route")
    return rounded(models.with_residuals(s, table, "p1", "y_persistence", "route").select("route", "bin", "calibrated", "status"), "calibrated")


@register("ax17_model_json", f"with {_RES} select route, round(w,6) as slope, round(me - w*mx,6) as intercept, 1 as features from w")
def ax17(spark, d):
    """Coefficients through JSON and back, with the number of features and their names checked."""
    s = scored(spark, d)
    table = models.residual_table(s.filter("route in ('click', 'view')"), "p1", "y_persistence", "y_30", "route")
    back = models.from_json_model(models.to_json_model(table, ["change"], "route"), ["change"])
    return rounded(back.select("route", F.col("weights")[0].alias("slope"), F.col("weights")[1].alias("intercept"), F.size("features").alias("features")), "slope", "intercept")


@register("ax22_counts_as_series", "with b as (select event_type as route, cast(floor(epoch(ts)/3600) as bigint) as bin, count(*)::double as y from events where ts >= timestamp '2024-01-08 00:00:00' and ts < timestamp '2024-01-22 00:00:00' group by 1, 2) select a.route, a.bin, a.y, l.y as lag_1, p.y as label from b a left join b l on l.route = a.route and l.bin = a.bin - 1 left join b p on p.route = a.route and p.bin = a.bin + 3")
def ax22(spark, d):
    """Counts of a span of days in place of durations, with the same lags and labels."""
    e = raw(spark, d).filter((F.col("t") >= 1704672000) & (F.col("t") < 1705881600))
    b = e.groupBy(F.col("event_type").alias("route"), F.floor(F.col("t") / 3600).cast("long").alias("bin")).agg(F.count("*").cast("double").alias("y"))
    return b.withColumns({"lag_1": lags.at_offset("y", -1), "label": lags.at_offset("y", 3)})


@register("ax25_bridge", f"with {TIMED}, l as (select route, max(bin) as bin from timed group by 1) select t.route, t.bin, t.after_gap, round(lag_10,6) as lag_10, round(roll_mean_60,6) as roll_mean_60, round(slope_30,6) as slope_30, round(y_persistence,6) as y_persistence from timed t join l on l.route = t.route and l.bin = t.bin")
def ax25(spark, d):
    """Features of the newest bin, rebuilt from a history and what came after it."""
    b = ten_minutes(spark, d).select("route", "bin", "y", "n")
    cut = b.agg(F.max("bin").alias("b")).first().b - 3
    both = b.filter(F.col("bin") <= cut).unionByName(b.filter(F.col("bin") > cut))
    t = lags.timed_features(bins.with_after_gap(bins.with_gap(both)))
    newest = t.groupBy("route").agg(F.max("bin").alias("bin"))
    return rounded(t.join(newest, ["route", "bin"]).select("route", "bin", "after_gap", "lag_10", "roll_mean_60", "slope_30", "y_persistence"), "lag_10", "roll_mean_60", "slope_30", "y_persistence")


@register("m30_nowcast", f"with {_HGRID}, c as (select cast(floor(epoch(ts)/3600) as bigint) as bin, count(*)::double as cars from events where event_type = 'error' group by 1), x as (select g.route, cast(g.bin as bigint) as bin, g.y, coalesce(c.cars, 0) as v from grid g left join c on c.bin = g.bin where g.y is not null and g.route <> 'error'), m as (select route, count(*) as n, avg(v) as mv, stddev_pop(v) as sv, avg(y) as my, covar_pop(v, y) as cv from x group by 1), w as (select *, case when sv > 0 then (n*cv/sv)/(n + 1.0)/sv else 0 end as w from m) select x.route, bin, round(my + w*(v - mv),6) as nowcast from x join w on w.route = x.route")
def m30(spark, d):
    """The present value from another feed's counts of the same bin."""
    from ..operators import joins

    cars = raw(spark, d).filter("event_type = 'error'").groupBy(F.floor(F.col("t") / 3600).cast("long").alias("bin")).agg(F.count("*").cast("double").alias("cars"))
    x = joins.attached(hourly_grid(spark, d).filter("y is not null and route <> 'error'"), cars, ["bin"]).withColumn("cars", F.coalesce("cars", F.lit(0.0)))
    return rounded(models.with_ridge(x, ["cars"], "y", "route", out="nowcast").select("route", "bin", "nowcast"), "nowcast")
