"""Queries of joins, aggregates, set operations, metrics and statistics, with independent SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bins, calendar, joins, lags, metrics, significance
from .catalog import register
from .series_queries import _CALS, B10, TIMED, hourly, raw, rounded, ten_minutes, timed

_CAL = "select *, cast(floor((bin*600+28800)/86400) as bigint) as local_day, cast(floor(((bin*600+28800) % 86400)/60) as bigint) as tod_min from timed"
_SL = f"sl as (select b.*, case when is_morning_peak = 1 then 'morning' when is_evening_peak = 1 then 'evening' else 'other' end as period, case when is_weekend = 1 then 'weekend' else 'weekday' end as day_type from (select route, bin, y_30, y_persistence, p1, {_CALS} from (select c.*, (y_persistence + coalesce(lag(y_persistence) over (partition by route order by bin), y_persistence))/2 as p1 from ({_CAL}) c)) b where y_30 is not null)"
SCORED = f"{TIMED}, {_SL}"


def scored(spark, d) -> DataFrame:
    """Labelled bins with two causal candidates: persistence, and its mean with the value of the bin seen before."""
    t = calendar.with_slices(calendar.with_calendar(timed(spark, d)))
    before = F.lag("y_persistence").over(bins.ordered("route"))
    t = t.withColumn("p1", (F.col("y_persistence") + F.coalesce(before, "y_persistence")) / 2).filter("y_30 is not null")
    return t.withColumns({"actual": F.col("y_30"), "predicted": F.col("y_persistence")})


def _two(spark, d) -> tuple[DataFrame, DataFrame]:
    b = hourly(spark, d)
    return b.filter("route = 'click'").select("bin", "y"), b.filter("route = 'view'").select("bin", "y")


_B60 = B10.replace("/600", "/3600")


@register("j4_provider_compare", f"with {_B60}, a as (select bin, y from bins where route = 'click'), b as (select bin, y from bins where route = 'view') select bin, cast(round(a.y) as bigint) as a_round, cast(round(b.y) as bigint) as b_round, round(b.y - a.y,6) as difference, round(b.y / nullif(a.y,0),6) as ratio from a full join b using (bin)")
def j4(spark, d):
    return rounded(joins.compared(*_two(spark, d), ["bin"]), "difference", "ratio")


@register("j3_align", f"with {B10}, p as (select route, bin, lag(y) over (partition by route order by bin) as p from bins) select b.route, b.bin, round(b.y,6) as y, round(p.p,6) as p from bins b join p on b.route = p.route and b.bin = p.bin")
def j3(spark, d):
    b = ten_minutes(spark, d)
    p = b.select("route", "bin", F.lag("y").over(bins.ordered("route")).alias("p"))
    return rounded(joins.aligned(b.select("route", "bin", "y"), p, ["route", "bin"]), "y", "p")


@register("j14_monitor", f"with {B10} select f.route, f.bin as origin, f.bin + 3 as target, round(f.y,6) as forecast, round(a.y,6) as actual from bins f join bins a on a.route = f.route and a.bin = f.bin + 3")
def j14(spark, d):
    b = ten_minutes(spark, d)
    f = b.select("route", F.col("bin").alias("origin"), (F.col("bin") + 3).alias("target"), F.col("y").alias("forecast"))
    return rounded(f.join(b.select("route", F.col("bin").alias("target"), F.col("y").alias("actual")), ["route", "target"]), "forecast", "actual")


@register("j8_offsets", f"with {_B60} select o.route, o.bin, round(a.y,6) as actual, round(d1.y,6) as d1, round(d7.y,6) as d7 from bins o left join bins a on a.route = o.route and a.bin = o.bin + 1 left join bins d1 on d1.route = o.route and d1.bin = o.bin - 23 left join bins d7 on d7.route = o.route and d7.bin = o.bin - 167")
def j8(spark, d):
    b = hourly(spark, d)
    return rounded(joins.shifted_lookups(b.select("route", "bin"), b, "route", {"actual": 1, "d1": -23, "d7": -167}), "actual", "d1", "d7")


@register("j18_anti", "select event_id from events where user_id not in (select user_id from events where event_type = 'purchase' and value > 200)")
def j18(spark, d):
    e = raw(spark, d)
    return joins.not_yet(e, e.filter("event_type = 'purchase' and value > 200"), ["user_id"]).select("event_id")


@register("j7_served", "with r(event_type, model) as (values ('click','mean'),('view','max'),('purchase','persistence')) select event_id, r.model from events join r using (event_type)")
def j7(spark, d):
    registry = spark.createDataFrame([("click", "mean"), ("view", "max"), ("purchase", "persistence")], "event_type string, model string")
    return raw(spark, d).join(F.broadcast(registry), "event_type").select("event_id", "model")  # one row per series


@register("j19_parity", f"with {B10}, l as (select route, bin, y, lag(y) over (partition by route order by bin) as z from bins) select cast(0 as double) as y, max(case when z is null then 'infinity'::double else abs(z - y) end) as z from l")
def j19(spark, d):
    b = ten_minutes(spark, d)
    a = b.select("route", "bin", "y", F.lag("y").over(bins.ordered("route")).alias("z"))
    return joins.largest_difference(a, b.select("route", "bin", "y", F.col("y").alias("z")), ["route", "bin"], ["y", "z"])


@register("a4_two_level", "with f as (select l_orderkey, min(l_shipdate) as day, count(*) as n, count(*) filter (l_returnflag = 'R') as r, max(l_quantity) as top from lineitem group by 1) select cast(year(day) as bigint) as year, count(*) as orders, round(avg(n),6) as lines, round(avg(r),6) as returns, round(avg(top),6) as top from f group by 1")
def a4(spark, d):
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    per = line.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("day"), F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.max("l_quantity").alias("top"))
    return rounded(per.groupBy(F.year("day").cast("long").alias("year")).agg(F.count("*").alias("orders"), F.avg("n").alias("lines"), F.avg("r").alias("returns"), F.avg("top").alias("top")), "lines", "returns", "top")


@register("a6_unpivot", "with w as (select cast(floor(epoch(ts)/86400) as bigint) as day, avg(value) filter (event_type = 'click') as click, avg(value) filter (event_type = 'view') as view from events group by 1) select day, direction, round(v,6) as v from w unpivot (v for direction in (click, view))")
def a6(spark, d):
    e = raw(spark, d)
    wide = e.groupBy(F.floor(F.col("t") / 86400).cast("long").alias("day")).agg(F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("click"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("view"))
    return rounded(wide.unpivot(["day"], ["click", "view"], "direction", "v").filter("v is not null"), "v")


@register("a8_min_bins", f"with {B10}, c as (select route, bin, count(*) over (partition by route, cast(floor(bin/144) as bigint)) as c from bins) select route, bin from c where c >= 55")
def a8(spark, d):
    b = ten_minutes(spark, d).withColumn("day", F.floor(F.col("bin") / 144))
    full = b.groupBy("route", "day").count().filter("count >= 55").select("route", "day")
    return b.join(full, ["route", "day"], "left_semi").select("route", "bin")


@register("a9_coverage", f"with {TIMED}, u as (select route, avg((lag_10 is not null)::int) as lag_10, avg((roll_mean_30 is not null)::int) as roll_mean_30, avg((y_30 is not null)::int) as y_30 from timed group by 1) select route, feature, round(coverage,6) as coverage from u unpivot (coverage for feature in (lag_10, roll_mean_30, y_30))")
def a9(spark, d):
    return rounded(metrics.coverage(timed(spark, d), "route", ["lag_10", "roll_mean_30", "y_30"]), "coverage")


@register("a11_cube_slices", f"with {SCORED} select case when grouping(route)=1 then 'all' else route end as route, case when grouping(period)=1 then 'all' else period end as period, count(*) as n, round(avg(abs(y_persistence-y_30)),6) as mae, round(sqrt(avg((y_persistence-y_30)**2)),6) as rmse from sl group by cube(route, period)")
def a11(spark, d):
    return rounded(metrics.cube_scores(scored(spark, d), "route", "period"), "mae", "rmse")


@register("a12_grouping_sets", f"with {SCORED}, l as (select route, period, day_type, y_30, 'y_persistence' as candidate, y_persistence as p from sl union all select route, period, day_type, y_30, 'p1', p1 from sl) select candidate, coalesce(route,'both') as route, case when period is not null then 'period='||period when day_type is not null then 'day_type='||day_type else 'all' end as slice, count(*) as n, round(avg(abs(p-y_30)),6) as mae, round(sqrt(avg((p-y_30)**2)),6) as rmse from l group by grouping sets ((candidate,route),(candidate,route,period),(candidate,route,day_type),(candidate),(candidate,period),(candidate,day_type))")
def a12(spark, d):
    return rounded(metrics.slice_scores(scored(spark, d), "route", ["period", "day_type"], ["y_persistence", "p1"]), "mae", "rmse")


@register("a13_error_metrics", f"with {SCORED} select route, count(*) as n, round(avg(abs(y_persistence-y_30)),6) as mae, round(quantile_cont(abs(y_persistence-y_30),0.5),6) as median_ae, round(quantile_cont(abs(y_persistence-y_30),0.9),6) as p90_ae, round(sqrt(avg((y_persistence-y_30)**2)),6) as rmse, round(avg(y_persistence-y_30),6) as bias, round(avg((abs(y_persistence-y_30)<=15)::int),6) as share_within from sl group by 1")
def a13(spark, d):
    return rounded(metrics.error_metrics(scored(spark, d), ["route"]), "mae", "median_ae", "p90_ae", "rmse", "bias", "share_within")


_REG = "case when y_30 - y_persistence > 5 then 'rising' when y_30 - y_persistence < -5 then 'falling' else 'steady' end"


@register("a16_regimes", f"with {SCORED}, g as (select {_REG} as regime, count(*) as n, sum(abs(y_persistence-y_30)) as ae from sl group by 1) select regime, n, round(n/sum(n) over (),6) as row_share, round(ae/sum(ae) over (),6) as error_share from g")
def a16(spark, d):
    change = F.col("y_30") - F.col("y_persistence")
    rows = scored(spark, d).withColumn("regime", F.when(change > 5, "rising").when(change < -5, "falling").otherwise("steady"))
    return rounded(metrics.regime_shares(rows), "row_share", "error_share")


_LEVEL = "case when {0} < 30 then 'light' when {0} < 70 then 'moderate' else 'heavy' end"


def levels(spark, d) -> DataFrame:
    level = lambda c: F.when(F.col(c) < 30, "light").when(F.col(c) < 70, "moderate").otherwise("heavy")
    return metrics.confusion(scored(spark, d).select(level("y_30").alias("y"), level("p1").alias("p")), "y", "p")


@register("a17_confusion", f"with {SCORED} select {_LEVEL.format('y_30')} as y, {_LEVEL.format('p1')} as p, count(*) as n from sl group by 1, 2")
def a17(spark, d):
    return levels(spark, d)


@register("a17_classification", f"with {SCORED}, z as (select {_LEVEL.format('y_30')} as y, {_LEVEL.format('p1')} as p from sl), c as (select unnest(['light','moderate','heavy']) as k), f as (select k, 2.0*count(*) filter (y=k and p=k)/nullif(count(*) filter (y=k)+count(*) filter (p=k),0) as f1 from z, c group by 1) select (select count(*) from z) as n, round((select avg((y=p)::int) from z),6) as accuracy, round(avg(f1),6) as macro_f1, round((select avg((y||p in ('lightheavy','heavylight'))::int) from z),6) as severe_rate from f")
def a17_metrics(spark, d):
    return rounded(metrics.classification(levels(spark, d), "y", "p", ["light", "moderate", "heavy"]), "accuracy", "macro_f1", "severe_rate")


@register("a18_corr", f"with {SCORED}, r as (select route, y_30, y_persistence, rank() over (partition by route order by y_30) + (count(*) over (partition by route, y_30) - 1)/2.0 as a, rank() over (partition by route order by y_persistence) + (count(*) over (partition by route, y_persistence) - 1)/2.0 as b from sl) select route, count(*) as n, round(corr(y_30, y_persistence),6) as pearson, round(corr(a, b),6) as spearman from r group by 1")
def a18(spark, d):
    return rounded(metrics.correlations(scored(spark, d), "route", "y_30", "y_persistence"), "pearson", "spearman")


@register("a22_distinct", "select distinct user_id, event_type from events")
def a22(spark, d):
    return raw(spark, d).select("user_id", "event_type").distinct()


@register("u1_union", "select event_id, 'a' as provider from events where event_type = 'click' union all select event_id, 'b' from events where value > 50")
def u1(spark, d):
    e = raw(spark, d)
    return e.filter("event_type = 'click'").select("event_id", F.lit("a").alias("provider")).unionByName(e.filter("value > 50").select("event_id", F.lit("b").alias("provider")))


@register("u3_dedupe", "select event_id from events where event_type = 'click' union select event_id from events where value > 50")
def u3(spark, d):
    e = raw(spark, d)
    return e.filter("event_type = 'click'").select("event_id").union(e.filter("value > 50").select("event_id")).distinct()


@register("u5_latest_revision", "select user_id, arg_max(event_id, t * 1000000 + event_id) as event_id from (select *, cast(floor(epoch(ts)/3600) as bigint) as t from events) group by 1")
def u5(spark, d):
    e = raw(spark, d).withColumn("hour", F.floor(F.col("t") / 3600))
    return joins.latest_revision(e.select("user_id", "event_id", "hour"), ["user_id"], "hour", "event_id").select("user_id", "event_id")


@register("k4_upsert", "select c_custkey, case when c_custkey % 10 = 0 then 'new' else c_mktsegment end as seg from customer union all select c_custkey + 1000000, 'new' from customer where c_custkey % 100 = 0")
def k4(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    source = c.filter("c_custkey % 10 = 0").select("c_custkey", F.lit("new").alias("seg")).union(c.filter("c_custkey % 100 = 0").select(F.col("c_custkey") + 1000000, F.lit("new")))
    return joins.upserted(c, source, ["c_custkey"])


@register("o2_latest_row", "select event_id, user_id from events order by ts desc, event_id desc limit 1")
def o2(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "ts").orderBy(F.desc_nulls_last("ts"), F.desc_nulls_last("event_id")).limit(1).select("event_id", "user_id")


@register("o4_argmin", f"with {B10} select route, arg_min(bin, y * 1e6 + bin / 1e6) as bin from bins group by 1")
def o4(spark, d):
    return ten_minutes(spark, d).groupBy("route").agg(F.min_by("bin", F.struct("y", "bin")).alias("bin"))


@register("e1_loss", f"with {SCORED} select route, bin, round(abs(y_30 - p1) - abs(y_30 - y_persistence),6) as d from sl")
def e1(spark, d):
    return rounded(significance.loss_differential(scored(spark, d), "y_30", "p1", "y_persistence").select("route", "bin", "d"), "d")


@register("e2_hac", f"with {SCORED}, x as (select route, row_number() over (partition by route order by bin) as i, abs(y_30 - p1) - abs(y_30 - y_persistence) as d from sl), m as (select avg(d) as m, count(*) as n from x), c as (select route, i, d - m as e from x, m), k as (select unnest(range(0, 8)) as k), g as (select k, sum(a.e * b.e) as s from k, c a join c b on a.route = b.route where b.i = a.i + k group by 1) select round(sum(s * case when k = 0 then 1 else 2 * (1 - k / 8.0) end) / (select n * n from m),9) as variance, (select n from m) as n, round((select m from m),6) as mean from g")
def e2(spark, d):
    x = significance.loss_differential(scored(spark, d), "y_30", "p1", "y_persistence")
    return rounded(rounded(significance.hac_variance(x, "route", "bin", 7), "variance", digits=9), "mean")


@register("e5_block", f"with {SCORED}, c as (select route, local_day, count(*) as c from sl group by 1, 2) select cast(round_even(median(c),0) as bigint) as block from c")
def e5(spark, d):
    return significance.day_block(scored(spark, d), "route", "local_day")


@register("e9_holm", "with t as (select p_brand as id, least(1.0, avg(p_retailprice)/2000*0.02) as p from part group by 1), k as (select *, row_number() over (order by p, id) as k, count(*) over () as m from t) select id, round(least(1.0, max((m-k+1)*p) over (order by k rows unbounded preceding)),9) as adjusted, m as family_size from k")
def e9(spark, d):
    t = spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_brand").alias("id")).agg(F.least(F.lit(1.0), F.avg("p_retailprice") / 2000 * 0.02).alias("p"))
    return rounded(significance.holm(t).drop("p"), "adjusted", digits=9)


@register("e4_diebold_mariano")
def e4(spark, d):
    """Statistic and p-values per comparison; the t distribution isn't SQL, tests hold it against closed forms."""
    x = significance.loss_differential(scored(spark, d), "y_30", "p1", "y_persistence")
    r = significance.hac_variance(x, "route", "bin", 7).first()
    stat, one, two = significance.diebold_mariano(r["mean"], r["variance"], r["n"], 3)
    return spark.createDataFrame([(r["n"], r["mean"], stat, one, two)], "n long, mean double, statistic double, p_better double, p_two_sided double")


@register("e7_day_bootstrap")
def e7(spark, d):
    x = significance.loss_differential(scored(spark, d), "y_30", "p1", "y_persistence")
    return spark.createDataFrame([significance.day_bootstrap(x, "local_day")], "mean double, low double, high double")
