"""Queries of series shaping, forecasters, combiners and detections, with SQL oracles where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import boosting, calendar, detect, horizons, lags, models, network, sampling, seasonal, shaping, stacks
from .catalog import register
from .series_queries import _HGRID, TIMED, hourly_grid, raw, rounded, timed
from .table_queries import SCORED, scored


@register("w14_slew", f"with recursive {_HGRID}, n as (select route, bin, y, row_number() over (partition by route order by bin) as i from grid), s as (select route, bin, i, y as limited from n where i = 1 union all select n.route, n.bin, n.i, case when n.y is null then null when s.limited is null then n.y else s.limited + greatest(least(n.y - s.limited, 10.0), -10.0) end from s join n on n.route = s.route and n.i = s.i + 1) select route, cast(bin as bigint) as bin, round(limited,6) as limited from s")
def w14(spark, d):
    return rounded(shaping.slew_limited(hourly_grid(spark, d), 10.0).drop("y"), "limited")


@register("w16_trend", f"with {_HGRID} select route, cast(bin as bigint) as bin, round(y - lag(y) over w,6) as last_diff, round(avg(y) over (partition by route order by bin rows between 11 preceding and current row),9) as recent_mean from grid window w as (partition by route order by bin)")
def w16(spark, d):
    return rounded(rounded(shaping.trends(hourly_grid(spark, d)).drop("y"), "last_diff"), "recent_mean", digits=9)


@register("w17_zscore", f"with {_HGRID}, s as (select a.route, a.bin, b.bin as pb, b.y, count(b.y) over p as c, avg(b.y) over p as m, stddev_pop(b.y) over p as sd from grid a join grid b on b.route = a.route and b.bin between a.bin - 5 and a.bin window p as (partition by a.route, a.bin)) select route, cast(bin as bigint) as bin, cast(pb - bin + 5 as bigint) as pos, round(case when sd > 0 then (y - m) / sd else 0 end,5) as z from s where c = 6")
def w17(spark, d):
    x = shaping.windows(hourly_grid(spark, d), 6)
    return rounded(x.select("route", "bin", F.posexplode(shaping.z_scored(F.col("x"))).alias("pos", "z")).withColumn("pos", F.col("pos").cast("long")), "z", digits=5)


@register("w18_wavelet")
def w18(spark, d):
    """Mean, deviation and db2 coefficients of each complete window of 36 bins, as arrays; w18_coefficients has them with SQL."""
    return shaping.wavelet_features(hourly_grid(spark, d)).select("route", "bin", "dwt_mean", "dwt_std", "coefficients")


@register("w19_supervised", f"with {_HGRID}, s as (select route, bin, y, count(y) over (partition by route order by bin rows between 5 preceding and current row) as c, lead(y,3) over w as label, y as lag_1, lag(y,1) over w as lag_2, lag(y,2) over w as lag_3 from grid window w as (partition by route order by bin)) select route, cast(bin as bigint) as bin, round(label,6) as label, round(lag_1,6) as lag_1, round(lag_2,6) as lag_2, round(lag_3,6) as lag_3 from s where c = 6 and label is not null")
def w19(spark, d):
    return rounded(shaping.supervised(hourly_grid(spark, d), 6, 3, 3).drop("y"), "label", "lag_1", "lag_2", "lag_3")


_PT = "p as (select event_type as route, cast(floor(epoch(ts)/60)*60 as bigint) as t, avg(value) as y from events group by 1, 2)"


def minute_points(spark, d) -> DataFrame:
    return raw(spark, d).groupBy(F.col("event_type").alias("route"), (F.floor(F.col("t") / 60) * 60).cast("long").alias("t")).agg(F.avg("value").alias("y"))


@register("w21_carry", f"with {_PT} select route, t + k*600 as t, round(y,6) as y, cast(k > 0 as bigint) as carried from p, (select unnest(range(0,2)) as k)")
def w21(spark, d):
    return rounded(shaping.carried_forward(minute_points(spark, d), 1200), "y")


@register("w22_midpoints", f"with {_PT}, n as (select *, lead(t) over w as t2, lead(y) over w as y2 from p window w as (partition by route order by t)), g as (select *, t2 - t as gap, cast(round((t2 - t)/300.0) as bigint) as steps from n), k as (select * from g where steps >= 2 and abs(gap - steps*300) <= 60 and gap <= 3600) select route, t, round(y,6) as y, cast(0 as bigint) as interpolated from p union all select route, cast(t + i*300 as bigint), round(y + (y2 - y)*(i*300)/gap,6), 1 from k, lateral (select unnest(range(1, steps)) as i)")
def w22(spark, d):
    return rounded(shaping.midpoints(minute_points(spark, d), "route"), "y")


@register("w23_trend_arrow", "with e as (select user_id, cast(floor(epoch(ts)) as bigint) as t, value as y from events), m as (select user_id, max(t) as e from e group by 1), s as (select user_id, avg(y) filter (m.e - t < 259200) as r, avg(y) filter (m.e - t >= 259200 and m.e - t < 777600) as p, count(y) filter (m.e - t < 259200) as a, count(y) filter (m.e - t >= 259200 and m.e - t < 777600) as b from e join m using (user_id) group by 1) select user_id, case when a >= 3 and b >= 3 then case when r/p > 1.1 then 'up' when r/p < 0.9 then 'down' else 'flat' end end as arrow from s")
def w23(spark, d):
    return shaping.trend_arrow(raw(spark, d).withColumn("y", F.col("value")), "user_id", recent_s=259200, prior_s=518400)


_SLOT = f"with {_HGRID}, s as (select route || '/' || cast(floor(bin/24) as bigint) as k, bin % 24 as slot, y from grid where y is not null)"


def slots(spark, d) -> DataFrame:
    g = hourly_grid(spark, d).filter("y is not null")
    return g.select(F.concat_ws("/", "route", F.floor(F.col("bin") / 24).cast("long").cast("string")).alias("k"), (F.col("bin") % 24).alias("slot"), "y")


@register("w25_decide", f"{_SLOT}, q as (select k, quantile_cont(y,0.25) as q from s group by 1), i as (select s.k, slot, slot - row_number() over (partition by s.k order by slot) as i from s join q on q.k = s.k where y <= q.q), r as (select k, min(slot) as first, max(slot) as last from i group by k, i having count(*) >= 2), f as (select k, min(first) as first, arg_min(last, first) as last from r group by 1), w as (select k, slot as first, lead(slot) over (partition by k order by slot) as last, (y + lead(y) over (partition by k order by slot))/2 as m from s), l as (select k, arg_min(first, m*1e6 + first) as first, arg_min(last, m*1e6 + first) as last from w where m is not null group by 1) select q.k, cast(coalesce(f.first, l.first) as bigint) as first, cast(coalesce(f.last, l.last) as bigint) as last, case when f.k is not null then 'quartile' else 'lowest_mean' end as rule from q left join f on f.k = q.k left join l on l.k = q.k")
def w25(spark, d):
    return shaping.best_window(slots(spark, d), "k")


@register("w26_around_minimum", f"{_SLOT}, b as (select k, arg_min(slot, y*1e6 + slot) as best, min(y) as low, arg_max(slot, y*1e6 - slot) as worst from s group by 1), i as (select s.k, slot, best, worst, slot - row_number() over (partition by s.k order by slot) as i from s join b on b.k = s.k where y <= low + 2), r as (select k, i, min(slot) as first, max(slot) as last, any_value(best) as best, any_value(worst) as worst from i group by 1, 2) select k, cast(first as bigint) as first, cast(last as bigint) as last, cast(best as bigint) as best, cast(worst as bigint) as worst from r where best between first and last")
def w26(spark, d):
    return shaping.around_minimum(slots(spark, d), "k")


@register("w27_runs", "with d as (select o_orderstatus as k, cast(epoch(o_orderdate)/86400 as bigint) as day, count(*) as c from orders group by 1, 2), m as (select k, day, day - row_number() over (partition by k order by day) as i from d where c >= 4) select k, min(day) as first, max(day) as last, count(*) as n from m group by k, i")
def w27(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderstatus").alias("k"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("day")).agg(F.count("*").alias("c"))
    return shaping.islands(o, "k", "day", F.col("c") >= 4)


@register("w27_calendar_facts", "with d as (select o_orderstatus as k, cast(epoch(o_orderdate)/86400 as bigint) as day, count(*) as c from orders group by 1, 2), m as (select k, day, day - row_number() over (partition by k order by day) as i from d where c >= 4), r as (select k, min(day) as first, max(day) as last from m group by k, i), x as (select d.k, d.day, c >= 4 as flag, (select min(m.day) from m where m.k = d.k and m.day between d.day + 1 and d.day + 21) as nxt from d) select x.k, x.day, r.first, r.last, case when not flag then nxt end as next, case when not flag then nxt - x.day end as in_days from x left join r on r.k = x.k and x.day between r.first and r.last")
def w27_facts(spark, d):
    """Every day with the run of flagged days around it, or the next flagged day within three weeks."""
    o = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderstatus").alias("k"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("day")).agg(F.count("*").alias("c"))
    return shaping.flagged_runs(o, "k", "day", F.col("c") >= 4)


@register("m1_baselines", f"with {_HGRID}, t as (select a.route, a.bin, avg(b.y) as tod from grid a left join grid b on b.route = a.route and b.bin % 24 = a.bin % 24 and b.bin between a.bin - 168 and a.bin - 1 group by 1, 2) select g.route, cast(g.bin as bigint) as bin, round(g.y,6) as persistence, round(d1.y,6) as d1, round(d7.y,6) as d7, round(t.tod,6) as tod from grid g join t on t.route = g.route and t.bin = g.bin left join grid d1 on d1.route = g.route and d1.bin = g.bin - 24 left join grid d7 on d7.route = g.route and d7.bin = g.bin - 168")
def m1(spark, d):
    g = seasonal.same_time_mean(hourly_grid(spark, d), 24).withColumns({"d1": lags.at_offset("y", -24), "d7": lags.at_offset("y", -168)})
    return rounded(g.select("route", "bin", F.col("y").alias("persistence"), "d1", "d7", "tod"), "persistence", "d1", "d7", "tod")


@register("m2_ridge", f"with {SCORED}, m as (select route, count(*) as n, avg(y_persistence) as mx, stddev_pop(y_persistence) as sx, avg(y_30) as my, covar_pop(y_persistence, y_30) as c from sl group by 1), w as (select route, mx, my, case when sx > 0 then (n*c/sx)/(n + 1.0)/sx else 0 end as w from m) select sl.route, bin, round(my + w*(y_persistence - mx),6) as ridge from sl join w on w.route = sl.route")
def m2(spark, d):
    """Ridge of the label on persistence, alpha 1, per series."""
    s = scored(spark, d)
    return rounded(models.with_ridge(s, ["y_persistence"], "y_30", "route").select("route", "bin", "ridge"), "ridge")


def parted(spark, d) -> tuple[DataFrame, DataFrame]:
    """Labelled bins of the earlier days, whose labels don't reach the later ones, and those of the later days."""
    s = horizons.boundary_masked(horizons.split_days(scored(spark, d), cuts=(0.7, 0.7, 0.7), parts=("train", "train", "train", "test")), "y_30", 3, ("train", "test"))
    return s.filter("part = 'train'"), s.filter("part = 'test'")


@register("m3_ridge_imputed")
def m3(spark, d):
    """Median-imputed ridge over all lag features, fitted on the earlier days (medians too), predicted on the later; held against NumPy in the tests."""
    columns = ["lag_10", "lag_20", "lag_30", "roll_mean_30"]
    train, test = parted(spark, d)
    features = ["y_persistence", *columns, *(f"missing_{c}" for c in columns)]
    return models.with_ridge(models.imputed(test, columns, train), features, "y_30", "route", train=models.imputed(train, columns)).select("route", "bin", "ridge")


@register("m8_fourier")
def m8(spark, d):
    """Daily profiles per series of the earlier days, predicted on the later; held against NumPy in the tests."""
    train, test = parted(spark, d)
    return models.with_fourier(test, "y_30", "route", train=train).select("route", "bin", "profile")


@register("m9_hour_profile", f"with {SCORED}, h as (select s.*, cast(floor(((bin*600+28800) % 86400)/3600) as bigint) as h from sl s), f as (select route, h, day_type, avg(y_30) as f from h where bin % 2 = 0 group by 1, 2, 3), c as (select route, avg(y_30) as c from h where bin % 2 = 0 group by 1) select h.route, h.bin, round(coalesce(f.f, c.c),6) as profile from h left join f on f.route = h.route and f.h = h.h and f.day_type = h.day_type left join c on c.route = h.route")
def m9(spark, d):
    s = scored(spark, d)
    return rounded(models.hour_profile(s.filter("bin % 2 = 0"), s, "route", "y_30").select("route", "bin", "profile"), "profile")


@register("m6_folds", f"with {SCORED}, x as (select route, bin, y_30, cast(floor((bin*600+28800)/86400) as bigint) as day, cast(floor((bin*600+2400+28799)/86400) as bigint) as known from sl), days as (select distinct route, day from x), m as (select days.route, days.day, avg(p.y_30) as m from days left join x p on p.route = days.route and p.known < days.day group by 1, 2) select x.route, bin, round(m,9) as train_mean from x join m on m.route = x.route and m.day = x.day")
def m6(spark, d):
    """Rolling-origin daily folds: the mean of all labels known before the row's day."""
    return rounded(models.fold_means(scored(spark, d).select("route", "bin", "y_30", "local_day"), "route", "y_30").select("route", "bin", "train_mean"), "train_mean", digits=9)


_FOLD_ROWS = (
    f"with {SCORED}, x as (select route, bin, cast(floor((bin*600+28800)/86400) as bigint) as day, cast(floor((bin*600+2400+28799)/86400) as bigint) as known from sl), f as (select unnest(range(min(day), max(day) + 1)) as fold from x) select fold, case when day = fold then 'test' else 'train' end as part, count(*) as n from x, f where day = fold or known < fold group by 1, 2"
)


@register("m6_fold_rows", _FOLD_ROWS)
@register("m6_fold_rows_all", _FOLD_ROWS)
def m6_rows_all(spark, d):
    """The rows of the folds of every day from the table's first to its last, from daily sums."""
    days = scored(spark, d).groupBy("local_day", F.floor((F.col("bin") * 600 + 2400 + 28800 - 1) / 86400).alias("known")).agg(F.count("*").alias("n"))
    folds = days.agg(F.explode(F.sequence(F.min("local_day"), F.max("local_day"))).alias("fold"))
    part = F.when(F.col("local_day") == F.col("fold"), "test").when(F.col("known") < F.col("fold"), "train")
    return days.crossJoin(F.broadcast(folds)).withColumn("part", part).filter("part is not null").groupBy(F.col("fold").cast("long").alias("fold"), "part").agg(F.sum("n").alias("n"))


_SEL = f"with {SCORED}, x as (select route, bin, y_30, y_persistence as a, p1 as b, cast(floor((bin*600+28800)/86400) as bigint) as day from sl), e as (select route, day, sum(abs(a-y_30)) as a, sum(abs(b-y_30)) as b, row_number() over (partition by route order by day) as i from x group by 1, 2), s as (select t.route, t.day, case when sum(p.a) is null then 'y_persistence' when sum(p.b) < sum(p.a) then 'p1' else 'y_persistence' end as selected from e t left join e p on p.route = t.route and p.i between t.i - 3 and t.i - 1 group by 1, 2)"


@register("m14_select", f"{_SEL} select x.route, x.bin, selected, round(case when selected = 'p1' then b else a end,6) as prediction from x join s on s.route = x.route and s.day = x.day")
def m14(spark, d):
    return rounded(models.rolling_select(scored(spark, d), ["y_persistence", "p1"], "y_30", "route", "local_day").select("route", "bin", "selected", "prediction"), "prediction")


@register("m15_means", f"with {SCORED} select route, bin, round((y_persistence + p1)/2,6) as mix from sl")
def m15(spark, d):
    return rounded(scored(spark, d).select("route", "bin", ((F.col("y_persistence") + F.col("p1")) / 2).alias("mix")), "mix")


@register("m17_membership", f"with {SCORED} select route, bin, round(greatest(0.0, least(1.0, (25 - y_30)/10)),6) as light, round(greatest(0.0, least(1.0, (y_30 - 15)/10, (40 - y_30)/10)),6) as moderate, round(greatest(0.0, least(1.0, (y_30 - 30)/10)),6) as heavy from sl")
def m17(spark, d):
    return rounded(scored(spark, d).select("route", "bin", *(v.alias(k) for k, v in models.levels(F.col("y_30")).items())), "light", "moderate", "heavy")


_TERMS = "t as (select *, greatest(0.0, least(1.0, (25 - y_persistence)/10)) as l1, greatest(0.0, least(1.0, (y_persistence - 15)/10, (40 - y_persistence)/10)) as l2, greatest(0.0, least(1.0, (y_persistence - 30)/10)) as l3, case when y_30 < 30 then 'light' when y_30 < 70 then 'moderate' else 'heavy' end as class from sl), u as (select class, 'level=light' as rule, l1 as s from t union all select class, 'level=moderate', l2 from t union all select class, 'level=heavy', l3 from t), v as (select rule, class, sum(s) as s from u where s > 0 group by 1, 2)"


def fuzzy_inputs(spark, d):
    s = scored(spark, d)
    level = F.when(F.col("y_30") < 30, "light").when(F.col("y_30") < 70, "moderate").otherwise("heavy")
    return s.withColumn("class", level), {"level": models.levels(F.col("y_persistence"))}


@register("m18_rules", f"with {SCORED}, {_TERMS} select '|' || rule as rule, arg_max(class, s) as class, round(max(s)/sum(s),6) as certainty, round(sum(s),9) as support from v group by rule having sum(s) >= 2")
def m18(spark, d):
    rules = models.fuzzy_rules(*fuzzy_inputs(spark, d), "class")
    return rounded(rounded(rules, "certainty"), "support", digits=9)


@register("m18_predictions")
def m18_predict(spark, d):
    rows, terms = fuzzy_inputs(spark, d)
    rows = rows.withColumn("id", F.concat_ws("/", "route", F.col("bin").cast("string"))).withColumn("now", F.lit("moderate"))
    terms |= {"trend": models.trend_terms(F.col("y_persistence") - F.coalesce("lag_10", "y_persistence"))}
    return models.fuzzy_predict(rows, terms, models.fuzzy_rules(rows, terms, "class"), "id", "now").select("route", "bin", "class", "predicted_class")


@register("m19_c_means")
def m19(spark, d):
    """Centres and each row's memberships; tests hold them against NumPy."""
    s = scored(spark, d).select("route", "bin", "y_30", "y_persistence")
    centres = models.c_means(s, ["y_30", "y_persistence"], 3)
    u = models.memberships([F.col("y_30"), F.col("y_persistence")], centres)
    return s.select("route", "bin", *(x.alias(f"u{i}") for i, x in enumerate(u)))


TREE_FEATURES = ["y_persistence", "lag_10", "lag_20", "lag_30", "lag_60", "roll_mean_30", "roll_mean_60", "slope_30", "tod_min", "is_weekend"]


def known_rows(spark, d) -> DataFrame:
    """Labelled bins with the day on which their label is known."""
    return scored(spark, d).withColumn("known", stacks.known_day(F.col("bin")))


@register("m4_boosted")
def m4(spark, d):
    """Boosted trees over the lag and calendar features, refitted for every day and series on what was known, predicted out of sample; held against a plain booster in the tests."""
    return boosting.rolling_trees(known_rows(spark, d), TREE_FEATURES, "y_30", "local_day", "known", ["route"], ["route", "bin"]).select("route", "bin", F.col("trees").alias("gbt"))


@register("m5_seed_mean")
def m5(spark, d):
    """The mean of three such models of 200 rounds that differ in their seed alone."""
    return boosting.rolling_trees(known_rows(spark, d), TREE_FEATURES, "y_30", "local_day", "known", ["route"], ["route", "bin"], rounds=200, seeds=(0, 1, 2)).select("route", "bin", F.col("trees").alias("gbt"))


def member_rows(spark, d) -> DataFrame:
    """Labelled bins with both members of the day's fit, ridge and trees, and their mean."""
    s = known_rows(spark, d)
    filled = [f"f_{c}" for c in TREE_FEATURES]
    s = s.withColumns({f"f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0) if c == "slope_30" else F.col("y_persistence")) for c in TREE_FEATURES})
    s = horizons.rolling_ridge(s, filled, "y_30", "route", least=200).drop(*filled)
    s = boosting.rolling_trees(s, TREE_FEATURES, "y_30", "local_day", "known", ["route"], ["route", "bin"])
    return s.withColumn("ensemble", (F.col("ridge") + F.col("trees")) / 2)


@register("ax13_members")
def ax13(spark, d):
    """Every labelled bin with the forecasts of its day's fits: ridge and trees over the same features, and their mean."""
    return member_rows(spark, d).select("route", "bin", "ridge", "trees", "ensemble")


@register("ax15_backtest")
def ax15(spark, d):
    """Per series, day and model: rows and error of persistence, both members and their mean, all on the rows that have all of them."""
    return horizons.day_backtest(member_rows(spark, d), ["y_persistence", "ridge", "trees", "ensemble"], "y_30", "route", "local_day")


STEPS = [10, 20, 30, 40, 50, 60]


def step_rows(spark, d) -> DataFrame:
    """Bins with labels at six steps, their day's part, and labels of a later part left out."""
    t = calendar.with_calendar(timed(spark, d)).filter("y_persistence is not null").withColumns({f"l{m}": lags.at_offset("y", m // 10) for m in STEPS})
    t = horizons.split_days(t)
    for m in STEPS:
        t = horizons.boundary_masked(t, f"l{m}", m // 10)
    return t.withColumns({f"f_{c}": F.coalesce(F.col(c), F.lit(0.0) if c == "slope_30" else F.col("y_persistence")) for c in ("lag_10", "lag_20", "lag_30", "lag_60", "roll_mean_60", "slope_30")})


NET_FEATURES = ["y_persistence", "f_lag_10", "f_lag_20", "f_lag_30", "f_lag_60", "f_roll_mean_60", "f_slope_30", "tod_sin", "tod_cos", "is_weekend"]


@register("m20_mlp")
def m20(spark, d):
    """Five seeds of a network for six steps ahead as differences from the present, penalty and epoch chosen on inner days; forecasts of the validation and test days."""
    s = step_rows(spark, d).withColumn("held", F.when(F.col("part") == "fit", False).when(F.col("part") == "inner", True))
    model = network.fit(s, NET_FEATURES, [f"l{m}" for m in STEPS], "y_persistence", ["route", "bin"], "held")
    names = [f"mlp_{m}" for m in STEPS]
    out = network.predict(s.filter(F.col("part").isin("validation", "test")), model, NET_FEATURES, "y_persistence", names)
    return out.select("route", "bin", "part", *names)


@register("m25_residual", f"with {SCORED}, r as (select route, bin, p1, p1 - y_persistence as x, y_30 - p1 as e from sl), m as (select route, count(*) as n, avg(x) as mx, stddev_pop(x) as sx, avg(e) as me, covar_pop(x, e) as c from r group by 1), w as (select route, mx, me, case when sx > 0 then (n*c/sx)/(n + 1.0)/sx else 0 end as w from m) select r.route, bin, round(p1 + me + w*(x - mx),6) as calibrated from r join w on w.route = r.route")
def m25(spark, d):
    s = scored(spark, d)
    return rounded(models.with_residuals(s, models.residual_table(s, "p1", "y_persistence", "y_30", "route"), "p1", "y_persistence", "route").select("route", "bin", "calibrated"), "calibrated")


@register("r2_fallback", f"with {TIMED} select route, bin, round(coalesce(lag_60, roll_mean_30, y_persistence),6) as served, case when lag_60 is not null then 'lag_60' when roll_mean_30 is not null then 'roll_mean_30' else 'y_persistence' end as served_by from timed")
def r2(spark, d):
    return rounded(models.fallback_chain(timed(spark, d), ["lag_60", "roll_mean_30", "y_persistence"]).select("route", "bin", "served", "served_by"), "served")


@register("st3_closed_bins", "with b as (select event_type as route, cast(floor(epoch(ts)/600) as bigint) as bin, avg(value) as y, count(*) as n from events where value is not null group by 1, 2), m as (select max(epoch(ts)) as now from events) select route, bin, round(y,6) as y, n from b, m where bin*600 + 600 + 60 <= now")
def st3(spark, d):
    """Bins closed by a 60-second grace at the newest observation: the batch twin of streaming.closed_bins."""
    from ..streaming.closed_bins import closed

    e = raw(spark, d).withColumns({"route": F.col("event_type"), "ts": F.timestamp_seconds("t")})
    return rounded(closed(e, e.agg(F.max("t")).first()[0]), "y")


_BOX = "b as (select l_orderkey as frame, l_returnflag as cls, cast(l_orderkey*10+l_linenumber as bigint) as id, (l_partkey % 40)*1.0::double as x, (l_suppkey % 30)*1.0::double as y, 10.0::double + l_linenumber as w, 8.0::double + l_linenumber as h, cast(l_discount as double) as confidence from lineitem)"


def boxes(spark, d) -> DataFrame:
    """Synthetic boxes: an order is a frame, its lines are boxes."""
    n = F.col("l_linenumber")
    return spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.col("l_orderkey").cast("long").alias("frame"), F.col("l_returnflag").alias("cls"), (F.col("l_orderkey") * 10 + n).cast("long").alias("id"), (F.col("l_partkey") % 40).cast("double").alias("x"), (F.col("l_suppkey") % 30).cast("double").alias("y"),
        (n + 10.0).cast("double").alias("w"), (n + 8.0).cast("double").alias("h"), F.col("l_discount").cast("double").alias("confidence"),
    )


@register("v7_iou", f"with {_BOX}, p as (select a.id as a, c.id as b, greatest(0, least(a.x+a.w/2, c.x+c.w/2) - greatest(a.x-a.w/2, c.x-c.w/2)) * greatest(0, least(a.y+a.h/2, c.y+c.h/2) - greatest(a.y-a.h/2, c.y-c.h/2)) as i, a.w*a.h as s, c.w*c.h as t from b a join b c on a.frame = c.frame and a.id < c.id) select a, b, round(i/(s+t-i),6) as iou from p")
def v7(spark, d):
    b = boxes(spark, d)
    return rounded(b.alias("a").join(b.alias("b"), (F.col("a.frame") == F.col("b.frame")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), detect.iou().alias("iou")), "iou")


@register("v5_direction", f"with {_BOX} select id, case when x < 5 or x > 35 then 'Unknown' when y + h/2 < case when x <= 20 then 10 + (x-5)*10.0/15 else 20 - (x-20)*5.0/15 end then 'A' else 'B' end as direction from b")
def v5(spark, d):
    return detect.directed(boxes(spark, d), [(5, 10), (20, 20), (35, 15)]).select("id", "direction")


@register("v6_counts", f"with {_BOX}, k as (select *, case when x < 5 or x > 35 then 'Unknown' when y + h/2 < case when x <= 20 then 10 + (x-5)*10.0/15 else 20 - (x-20)*5.0/15 end then 'A' else 'B' end as dir from b) select frame, count(*) as total, count(*) filter (dir='A') as a, count(*) filter (dir='B') as b, count(*) filter (dir='Unknown') as unknown, round(max(y+h/2) - min(y-h/2),4) as extent, case when count(*) < 20 then 'low' when count(*) < 40 then 'moderate' when count(*) < 71 then 'high' else 'severe' end as level from k group by 1")
def v6(spark, d):
    return detect.frame_counts(detect.directed(boxes(spark, d), [(5, 10), (20, 20), (35, 15)]))


@register("v3_nms")
def v3(spark, d):
    return detect.suppressed(boxes(spark, d), 0.3).select("frame", "id")


@register("v4_dedupe")
def v4(spark, d):
    return detect.suppressed(boxes(spark, d), 0.6, by_class=False, smaller=True).select("frame", "id")


@register("j20_match")
def j20(spark, d):
    b = boxes(spark, d)
    return detect.matched(b.filter("id % 2 = 0"), b.withColumn("x", F.col("x") + 1), 0.5)


@register("a20_ap", f"with {_BOX}, m as (select cls, confidence, id % 3 = 0 as hit from b), s as (select cls, confidence, count(*) filter (hit) as t, count(*) as n from m group by 1, 2), c as (select cls, sum(t) over w as tp, sum(n) over w as k from s window w as (partition by cls order by confidence desc)), g as (select cls, count(*) as total from b where id % 2 = 0 group by 1), e as (select c.cls, c.tp/g.total as recall, c.tp/c.k as precision from c join g on g.cls = c.cls), r as (select g.cls, r/100.0 as r from g, (select unnest(range(0,101)) as r)) select r.cls, round(avg(coalesce((select max(precision) from e where e.cls = r.cls and e.recall >= r.r - 1e-9),0)),6) as ap from r group by 1")
def a20(spark, d):
    b = boxes(spark, d)
    return rounded(detect.average_precision(b.select("cls", "confidence", (F.col("id") % 3 == 0).alias("hit")), b.filter("id % 2 = 0")), "ap")


@register("w20_tensor", f"with {_HGRID}, s as (select a.route, a.bin, count(b.y) as c, sum(b.y * (b.bin - a.bin + 6)) as v from grid a join grid b on b.route = a.route and b.bin between a.bin - 5 and a.bin group by 1, 2) select route, cast(bin as bigint) as bin, round(v,6) as checksum from s where c = 6")
def w20(spark, d):
    """Sequence tensors of six bins, shown by a weighted sum of their first channel."""
    t = shaping.tensors(hourly_grid(spark, d).withColumn("z", F.lit(None).cast("double")), 6, ["y", "z"])
    weights = F.array(*(F.lit(float(i)) for i in range(1, 7)))
    return rounded(t.select("route", "bin", F.aggregate(F.zip_with("tensor", weights, lambda r, w: r[1] * w), F.lit(0.0), lambda a, v: a + v).alias("checksum")), "checksum")


@register("k9_snapshot", "with e as (select event_type, event_id, cast(floor(epoch(ts)) as bigint) as t from events), m as (select max(t) as now from e) select event_type as route, count(*) as points, min(t) as first, max(t) as last from e, m where t >= now - 86400 group by 1")
def k9(spark, d):
    """The last day's points per series, as written to a JSON snapshot; shown by their number and span."""
    from ..sources.sinks import snapshot

    e = raw(spark, d)
    s = snapshot(e, "event_type", "t", ["value"], e.agg(F.max("t")).first()[0])
    return s.select(F.col("event_type").alias("route"), F.size("points").cast("long").alias("points"), F.element_at("points", 1)["t"].alias("first"), F.element_at("points", -1)["t"].alias("last"))


_MD5 = lambda *of: "md5(concat_ws('/', '7', " + ", ".join(of) + "))"


@register(
    "u7_stratified",
    "with r as (select event_id, cast(case when hour(ts) < 2 then hour(ts) when hour(ts) < 6 then 2 else hour(ts) - 3 end as bigint) as bucket, cast(floor(epoch(ts)/604800) as bigint) as week from events), "
    f"k as (select *, row_number() over (partition by bucket, week order by {_MD5('bucket', 'week', 'event_id')}, event_id) as round from r), t as (select *, row_number() over (partition by bucket order by round, {_MD5('bucket', 'round', 'week')}, week, event_id) as turn from k), "
    f"q as (select b as bucket, 14 + (row_number() over (order by {_MD5('b')}) <= 6)::int as quota from range(21) x(b)) select event_id, t.bucket, week, turn from t join q on q.bucket = t.bucket where turn <= quota",
)
def u7(spark, d):
    """Three hundred rows, an equal quota per hour bucket, in which the weeks take turns (the events span a month)."""
    e = raw(spark, d).select("event_id", sampling.hour_bucket(F.floor(F.col("t") / 3600) % 24).alias("bucket"), F.floor(F.col("t") / 604800).cast("long").alias("week"))
    return sampling.stratified(e, 300, "bucket", "week", "event_id", 7).select("event_id", F.col("bucket").cast("long").alias("bucket"), "week", F.col("turn").cast("long").alias("turn"))


@register("s13_json_explode", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def s13(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@register("p16_text_flags", "select p_partkey, cast(regexp_matches(p_name, '(?i)a|e') as bigint) as rain, cast(regexp_matches(p_name, '(?i)red|blue') as bigint) as heavy from part")
def p16(spark, d):
    flag = lambda p: F.col("p_name").rlike(f"(?i){p}").cast("long")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", flag("a|e").alias("rain"), flag("red|blue").alias("heavy"))


@register("p17_recode", "select event_id, case when event_type = 'click' then 'A' when event_type in ('view','error') then 'B' else 'other' end as direction, case when value < 20 then 'low' when value < 40 then 'moderate' when value < 71 then 'high' else 'severe' end as level from events")
def p17(spark, d):
    v = F.col("value")
    return raw(spark, d).select("event_id", F.when(F.col("event_type") == "click", "A").when(F.col("event_type").isin("view", "error"), "B").otherwise("other").alias("direction"), F.when(v < 20, "low").when(v < 40, "moderate").when(v < 71, "high").otherwise("severe").alias("level"))


@register("p19_scalar_subquery", "select event_id from events where ts >= (select min(ts) + interval 10 days from events where event_type = 'error')")
def p19(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return spark.sql("select event_id from {e} where us >= (select min(us) + 864000000000 from {e} where event_type = 'error')", e=e)


@register("s4_parameters", "select event_id from events where event_type in ('click','view') and value > 50 and epoch(ts) >= 1705000000")
def s4(spark, d):
    args = {"types": F.array(F.lit("click"), F.lit("view")), "least": 50.0, "since": 1705000000}
    return spark.sql("select event_id from {e} where array_contains(:types, event_type) and value > :least and t >= :since", args=args, e=raw(spark, d))


@register("m10_profile_cv")
def m10(spark, d):
    """Leave-days-out error of daily profiles of 2, 4, 6 and 8 harmonics, folds by a hash of the day."""
    s = scored(spark, d).withColumn("fold", F.pmod(F.xxhash64("local_day"), F.lit(5)))
    return models.profile_errors(s, "y_30", "route", (2, 4, 6, 8))
