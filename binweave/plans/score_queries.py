"""Queries of metrics by step and slice, detections, statistics and decisions, with independent SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bins, comparison, detect, metrics, models, ranks, significance
from ..spec import SeriesSpec
from .catalog import register
from .model_queries import _BOX, boxes
from .series_queries import B10, BINS, events, raw, rounded, ten_minutes
from .table_queries import SCORED, scored

B5 = BINS.format(w=300)


@register("a2_five_minutes", f"with {B5}, span as (select route, min(bin) a, max(bin) b from bins group by 1), grid as (select s.route, g.bin from span s, lateral (select unnest(generate_series(s.a, s.b)) as bin) g) select g.route, cast(g.bin as bigint) as bin, round(b.y,6) as y from grid g left join bins b on b.route = g.route and b.bin = g.bin")
def a2(spark, d):
    """Five-minute means on a complete grid."""
    return rounded(bins.dense(bins.binned(events(spark, d), SeriesSpec(width_s=300))).select("route", "bin", "y"), "y")


@register("a8_summary", f"with {B10}, c as (select route, cast(floor(bin/144) as bigint) as day, count(*) as c from bins group by 1, 2) select route, count(*) as days, count(*) filter (c >= 55) as kept_days, cast(coalesce(sum(c) filter (c >= 55), 0) as bigint) as kept_bins from c group by 1")
def a8_summary(spark, d):
    return metrics.day_summary(ten_minutes(spark, d).withColumn("day", F.floor(F.col("bin") / 144)), "route", "day", 55)


@register("a10_mae_rmse", f"with {SCORED} select route, round(avg(abs(p1-y_30)),6) as mae, round(sqrt(avg((p1-y_30)**2)),6) as rmse from sl group by 1")
def a10(spark, d):
    e = metrics.error("y_30", "p1")
    return rounded(scored(spark, d).groupBy("route").agg(metrics.mae(e).alias("mae"), metrics.rmse(e).alias("rmse")), "mae", "rmse")


_STEPS = "u as (select route, period, day_type, model, step, actual, p from (select route, period, day_type, 30 as step, y_30 as actual, y_persistence, p1 from sl union all select route, period, day_type, 60, y_60, y_persistence, p1 from sl60 where y_60 is not null) t unpivot (p for model in (y_persistence, p1)))"


@register(
    "a15_steps",
    f"with {SCORED}, sl60 as (select sl.*, t.y_60 from sl join timed t on t.route = sl.route and t.bin = sl.bin), {_STEPS}, g as (select model, step, 'all' as grp, actual, p from u union all select model, step, 'route=' || route, actual, p from u union all select model, step, 'period=' || period, actual, p from u union all select model, step, 'day_type=' || day_type, actual, p from u) select model, cast(step as bigint) as step, grp, count(*) as n, round(avg(abs(p-actual)),6) as mae, round(sqrt(avg((p-actual)**2)),6) as rmse, round(avg((actual between p - 10 and p + 10)::int),6) as coverage from g group by 1, 2, 3",
)
def a15(spark, d):
    """Each model at each step, over all rows, by series, period and day type, with the coverage of an interval."""
    s = scored(spark, d)
    out = metrics.step_scores(s, {30: "y_30", 60: "y_60"}, ["y_persistence", "p1"], ["route", "period", "day_type"], 10.0)
    return rounded(out.withColumn("step", F.col("step").cast("long")), "mae", "rmse", "coverage")


@register("a17_rps", f"with {SCORED}, m as (select route, greatest(0.0, least(1.0, (25 - y_persistence)/10)) as a, greatest(0.0, least(1.0, (y_persistence - 15)/10, (40 - y_persistence)/10)) as b, case when y_30 < 20 then 0 when y_30 < 35 then 1 else 2 end as k from sl) select route, round(avg((pow(a - (k <= 0)::int, 2) + pow(a + b - (k <= 1)::int, 2))/2),6) as rps from m group by 1")
def a17_rps(spark, d):
    """Mean ranked probability score of fuzzy memberships against the level that came."""
    s = scored(spark, d).withColumns(models.levels(F.col("y_persistence"))).withColumn("k", F.when(F.col("y_30") < 20, 0).when(F.col("y_30") < 35, 1).otherwise(2))
    return rounded(s.groupBy("route").agg(F.avg(metrics.ranked_probability(["light", "moderate", "heavy"], "k")).alias("rps")), "rps")


@register("a17_recall", f"with {SCORED}, z as (select case when y_30 < 30 then 'light' when y_30 < 70 then 'moderate' else 'heavy' end as y, case when p1 < 30 then 'light' when p1 < 70 then 'moderate' else 'heavy' end as p from sl) select y as class, count(*) as n, round(avg((y = p)::int),6) as recall from z group by 1")
def a17_recall(spark, d):
    from .table_queries import levels

    return rounded(metrics.recalls(levels(spark, d), "y", "p"), "recall")


_DAYM = f"{SCORED}, dm as (select route, floor((bin*600+28800)/86400) as day, avg(y_30) as x, avg(y_persistence) as y from sl group by 1, 2)"


@register(
    "a18_kendall",
    f"with {SCORED}, q as (select a.route, sign(b.y_30 - a.y_30) as sx, sign(b.y_persistence - a.y_persistence) as sy from sl a join sl b on a.route = b.route and a.bin < b.bin), t as (select route, sum(sx*sy) as s, count(*) filter (sx <> 0) as nx, count(*) filter (sy <> 0) as ny from q group by 1), n as (select route, count(*)::double as n from sl group by 1), "
    "cx as (select route, count(*)::double as t from sl group by route, y_30), cy as (select route, count(*)::double as t from sl group by route, y_persistence), tx as (select route, sum(t*(t-1)) as a, sum(t*(t-1)*(t-2)) as b, sum(t*(t-1)*(2*t+5)) as v from cx group by 1), ty as (select route, sum(t*(t-1)) as a, sum(t*(t-1)*(t-2)) as b, sum(t*(t-1)*(2*t+5)) as v from cy group by 1), "
    "z as (select t.route, n, s/sqrt(nx::double*ny) as tau, s/sqrt((n*(n-1)*(2*n+5) - tx.v - ty.v)/18 + tx.a*ty.a/(2*n*(n-1)) + tx.b*ty.b/(9*n*(n-1)*(n-2))) as z from t join n on n.route = t.route join tx on tx.route = t.route join ty on ty.route = t.route) "
    "select route, cast(n as bigint) as n, round(tau,6) as tau, round(z,6) as z, round(2*0.005/3*list_sum(list_transform(range(2001), lambda k: (case when k in (0, 2000) then 1 when k % 2 = 1 then 4 else 2 end)*exp(-(abs(z) + 0.005*k)*(abs(z) + 0.005*k)/2)/sqrt(2*pi()))),6) as p from z",
)
def a18_kendall(spark, d):
    """Kendall's tau-b over all bins of a series, with its normal score and p; SQL joins all pairs."""
    return rounded(ranks.kendall(scored(spark, d), ["route"], "y_30", "y_persistence"), "tau", "z", "p")


@register("a19_count_error", "with e as (select case when hour(ts) between 7 and 18 then 'day' else 'night' end as part, cast(round(value) as bigint) as y, cast(round(value) + event_id % 7 - 3 as bigint) as p from events), u as (select part, p - y as e from e union all select 'all', p - y from e) select part, count(*) as n, round(avg(abs(e)),2) as mae, round(avg(e),2) + 0.0 as bias, round(avg((e = 0)::int),6) as exact, round(avg((abs(e) <= 2)::int),6) as within_2 from u group by 1")
def a19(spark, d):
    y = F.round("value").cast("long")
    e = events(spark, d).select(F.when(F.hour("ts").between(7, 18), "day").otherwise("night").alias("part"), y.alias("y"), (y + F.col("event_id") % 7 - 3).alias("p"))
    return rounded(metrics.count_errors(e, "part", "y", "p"), "exact", "within_2")


_DIR = "k as (select *, case when x < 5 or x > 35 then 'Unknown' when y + h/2 < case when x <= 20 then 10 + (x-5)*10.0/15 else 20 - (x-20)*5.0/15 end then 'A' else 'B' end as dir from b)"


@register("a21_image_counts", f"with {_BOX}, {_DIR} select frame, count(*) filter (dir = 'A' and confidence >= 0.05) - count(*) filter (dir = 'A' and id % 2 = 0) as a_error, count(*) filter (dir = 'B' and confidence >= 0.05) - count(*) filter (dir = 'B' and id % 2 = 0) as b_error from k group by 1")
def a21(spark, d):
    """Predicted less true counts of each direction and frame: the confident boxes against the even ones."""
    b = detect.directed(boxes(spark, d), [(5, 10), (20, 20), (35, 15)])
    return detect.count_errors(b.withColumns({"predicted": F.col("confidence") >= 0.05, "true": F.col("id") % 2 == 0}), ["A", "B"])


@register("a23_day_coverage", "with e as (select cast(floor(epoch(ts)/600) as bigint) as bin, case when event_id % 3 = 0 then 'stale_frame' when event_id % 5 = 0 then 'error' else 'ok' end as status, ts, event_id from events), l as (select bin, arg_max(status, epoch_us(ts) * 1.0 + event_id / 1e9) as status from e group by 1) select cast(floor((bin*600+28800)/86400) as bigint) as local_day, count(*) as recorded, count(*) filter (status = 'ok') as ok from l group by 1")
def a23(spark, d):
    """Of each day's bins the recorded ones and those whose latest status is ok."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("u"), F.when(F.col("event_id") % 3 == 0, "stale_frame").when(F.col("event_id") % 5 == 0, "error").otherwise("ok").alias("status"))
    return metrics.day_coverage(e.withColumn("bin", F.floor(F.col("u") / 600_000_000).cast("long")), ["u", "event_id"])


@register("a24_outcomes", "with d as (select cast(floor(epoch(ts)/86400) as bigint) as day, count(*) as n, count(*) filter (event_type = 'error') as bad from events group by 1), s as (select case when n = 0 then 'no_data' when bad * 5 > n then 'partial' when n < 300 then 'skipped' else 'fetched' end as outcome from d) select outcome, count(*) as days from s group by 1")
def a24(spark, d):
    days = raw(spark, d).groupBy(F.floor(F.col("t") / 86400).alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))
    outcome = F.when(F.col("n") == 0, "no_data").when(F.col("bad") * 5 > F.col("n"), "partial").when(F.col("n") < 300, "skipped").otherwise("fetched")
    return days.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("days"))


@register("a25_backtest", f"with {SCORED}, x as (select floor((bin*600+28800)/86400) as day, avg(abs(y_persistence-y_30)) as y_persistence, avg(abs(p1-y_30)) as p1 from sl group by 1), u as (select method, mae from x unpivot (mae for method in (y_persistence, p1))) select method, count(*) as days, round(avg(mae),6) as mae from u group by 1")
def a25(spark, d):
    """Mean over days of each method's daily error."""
    return rounded(metrics.mean_of_days(scored(spark, d), "local_day", "y_30", ["y_persistence", "p1"]), "mae")


@register("a26_sweep", f"with {_BOX}, t as (select unnest(range(0, 10))/100.0 as least), g as (select cls, count(*) as truths from b where id % 2 = 0 group by 1), s as (select t.least, b.cls, count(*) filter (confidence >= least) as kept, count(*) filter (confidence >= least and id % 3 = 0) as hits from b, t group by 1, 2) select s.cls, round(least,2) as least, kept, hits, round(hits/nullif(kept,0)::double,6) as precision, round(hits/truths::double,6) as recall, round(2.0*hits/(kept+truths),6) as f1, round(kept/truths::double,6) as ratio from s join g on g.cls = s.cls")
def a26(spark, d):
    """Precision, recall, F1 and count ratio of every class over confidence thresholds."""
    b = boxes(spark, d)
    out = metrics.threshold_sweep(b.select("cls", "confidence", (F.col("id") % 3 == 0).alias("hit")), b.filter("id % 2 = 0"), [i / 100 for i in range(10)])
    return rounded(out, "precision", "recall", "f1", "ratio")


_KEPT = "select frame, unnest(kept).id as id from (select frame, arg_max(kept, k) as kept from r group by 1)"
UBOX = _BOX.replace("b as (", "b0 as (").replace("cast(l_orderkey*10+l_linenumber as bigint) as id", "cast(l_orderkey*100000000000 + l_partkey*1000000 + l_suppkey*10 + l_linenumber as bigint) as id") + ", b as (select frame, cls, id, x, y, w, h, max(confidence) as confidence from b0 group by all)"
_INTER = "greatest(0, least(q.x+q.w/2, o.x+o.w/2) - greatest(q.x-q.w/2, o.x-o.w/2)) * greatest(0, least(q.y+q.h/2, o.y+o.h/2) - greatest(q.y-q.h/2, o.y-o.h/2))"
_ONE = "{'id': o.id, 'cls': o.cls, 'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h}"


def unique_boxes(spark, d) -> DataFrame:
    """The boxes under ids that no two boxes of a class share; a line that stands twice is one box."""
    n = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") * 100000000000 + F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"), F.col("l_orderkey").cast("long").alias("frame"), F.col("l_returnflag").alias("cls"), "l_partkey", "l_suppkey", "l_linenumber", "l_discount")
    k = F.col("l_linenumber")
    return n.select("frame", "cls", "id", (F.col("l_partkey") % 40).cast("double").alias("x"), (F.col("l_suppkey") % 30).cast("double").alias("y"), (k + 10.0).cast("double").alias("w"), (k + 8.0).cast("double").alias("h"), F.col("l_discount").cast("double").alias("confidence")).groupBy("frame", "cls", "id", "x", "y", "w", "h").agg(F.max("confidence").alias("confidence"))


def greedy(hit: str, least: float = 0.0, order: str = "confidence desc, id") -> str:
    """SQL of a walk through each frame's boxes in an order that keeps those without a hit among the kept: CTEs up to r."""
    ranked = f"o as (select *, row_number() over (partition by frame order by {order}) as k from b where confidence >= {least})"
    return f"with recursive {UBOX}, {ranked}, r as (select frame, k, [{_ONE}] as kept from o where k = 1 union all select o.frame, o.k, case when len(list_filter(r.kept, lambda q: {hit})) = 0 then list_append(r.kept, {_ONE}) else r.kept end from r join o on o.frame = r.frame and o.k = r.k + 1)"


OVERLAP = f"{_INTER} / greatest(1e-12, least(q.w*q.h, o.w*o.h)) > 0.6 and greatest(q.w*q.h, o.w*o.h) < 3.0 * least(q.w*q.h, o.w*o.h)"


@register("v3_nms_boxes", f"{greedy(f'q.cls = o.cls and {_INTER} / greatest(1e-12, q.w*q.h + o.w*o.h - {_INTER}) > 0.3')} {_KEPT}")
def v3_boxes(spark, d):
    return detect.suppressed(unique_boxes(spark, d), 0.3).select("frame", "id")


@register("v4_dedupe_by_size", f"{greedy(OVERLAP, order='w*h desc, confidence desc, id')} {_KEPT}")
def v4_by_size(spark, d):
    """The largest boxes first."""
    return detect.suppressed(unique_boxes(spark, d), 0.6, by_class=False, smaller=True, order_by="size").select("frame", "id")


@register("v4_dedupe_boxes", f"{greedy(OVERLAP, order='confidence desc, w*h desc, id')} {_KEPT}")
def v4_boxes(spark, d):
    return detect.suppressed(unique_boxes(spark, d), 0.6, by_class=False, smaller=True).select("frame", "id")


_FREE = "list_max(list_transform(r.free, lambda q: {'v': INTER / greatest(1e-12, q.w*q.h + o.w*o.h - INTER), 'id': q.id}))".replace("INTER", _INTER)


@register(
    "j20_matched_boxes",
    f"with recursive {UBOX}, t as (select frame, cls, list({_ONE.replace('o.', '')}) as free from b where id % 2 = 0 group by 1, 2), o as (select frame, cls, id, x + 1 as x, y, w, h, confidence, row_number() over (partition by frame, cls order by confidence desc, id) as k from b), r as (select s.frame, s.cls, cast(0 as bigint) as k, coalesce(t.free, []) as free, cast(null as bigint) as id, cast(null as boolean) as hit from (select distinct frame, cls from o) s left join t on t.frame = s.frame and t.cls = s.cls union all select frame, cls, k, case when hit then list_filter(free, lambda q: q.id <> best.id) else free end, id, hit from (select o.frame, o.cls, o.k, o.id, r.free, {_FREE} as best, coalesce(({_FREE}).v >= 0.5, false) as hit from r join o on o.frame = r.frame and o.cls = r.cls and o.k = r.k + 1) z) select frame, cls, r.id, confidence, hit from r join (select id, any_value(confidence) as confidence from b group by 1) c on c.id = r.id where r.id is not null",
)
def j20_boxes(spark, d):
    """Greedy one-to-one matching of moved boxes with the even ones, within frame and class."""
    b = unique_boxes(spark, d)
    return detect.matched(b.filter("id % 2 = 0"), b.withColumn("x", F.col("x") + 1), 0.5)


@register(
    "a20_precision_recall",
    f"with {UBOX}, m as (select cls, count(*) filter (confidence >= 0.05) as kept, count(*) filter (confidence >= 0.05 and id % 3 = 0) as hits, count(*) filter (id % 2 = 0) as truths from b group by 1) select cls, kept, hits, truths, round(hits/nullif(kept,0)::double,6) as precision, round(hits/nullif(truths,0)::double,6) as recall from m",
)
def a20_precision(spark, d):
    """Precision and recall of each class from a confidence on."""
    b = unique_boxes(spark, d)
    out = metrics.threshold_sweep(b.select("cls", "confidence", (F.col("id") % 3 == 0).alias("hit")), b.filter("id % 2 = 0"), [0.05])
    return rounded(out.join(b.filter("id % 2 = 0").groupBy("cls").agg(F.count("*").alias("truths")), "cls").select("cls", "kept", "hits", "truths", "precision", "recall"), "precision", "recall")


@register("a20_coco")
def a20_coco(spark, d):
    """Average precision over overlaps from .50 to .95, as the mean of the ten; held against a plain walk in the tests."""
    b = unique_boxes(spark, d)
    return detect.coco_precision(b.filter("id % 2 = 0"), b.withColumn("x", F.col("x") + 1))


@register("e3_hac_lag", f"with {SCORED}, c as (select route, count(*) as n from sl group by 1), l as (select route, n, greatest(2, cast(floor(4*pow(n/100.0, 2.0/9)) as bigint)) as lag from c) select route, n, lag, least(greatest(lag, 40), greatest(1, n//3)) as clamped from l")
def e3(spark, d):
    n = scored(spark, d).groupBy("route").agg(F.count("*").alias("n"))
    return n.select("route", "n", significance.hac_lag_column(F.col("n"), 3).alias("lag"), significance.hac_lag_column(F.col("n"), 3, 40).alias("clamped"))


@register(
    "e4_statistic",
    f"with {SCORED}, x as (select route, row_number() over (partition by route order by bin) as i, abs(y_30 - p1) - abs(y_30 - y_persistence) as d from sl), m as (select avg(d) as m, count(*) as n from x), c as (select route, i, d - m as e from x, m), k as (select unnest(range(0, 8)) as k), g as (select k, sum(a.e * b.e) as s from k, c a join c b on a.route = b.route where b.i = a.i + k group by 1), v as (select sum(s * case when k = 0 then 1 else 2 * (1 - k / 8.0) end) as v from g) select n, round(case when v <= 0 then 0.0 else sqrt((n + 1 - 6 + 6.0/n)/n) * m / sqrt(v/(n::double*n)) end,5) as statistic from m, v",
)
def e4_statistic(spark, d):
    """Diebold-Mariano's statistic with the small-sample factor, horizon 3."""
    x = significance.loss_differential(scored(spark, d), "y_30", "p1", "y_persistence")
    v = significance.hac_variance(x, "route", "bin", 7)
    return rounded(v.select("n", significance.diebold_mariano_column(F.col("mean"), F.col("variance"), F.col("n"), 3).alias("statistic")), "statistic", digits=5)


_D = f"{SCORED}, x as (select route, bin, period, day_type, cast(floor((bin*600+28800)/86400) as bigint) as day, abs(y_30 - p1) - abs(y_30 - y_persistence) as d from sl)"
_HEX = "cast('0x' || substr(md5({0}), 1, 8) as bigint)"


@register(
    "e6_block_bootstrap",
    f"with {_D}, s as (select route, row_number() over w as i, sum(d) over (partition by route order by bin rows unbounded preceding) as s from x window w as (partition by route order by bin)), p as (select * from s union all select distinct route, 0, 0.0 from s), z as (select route, count(*) as n, least(48, count(*)) as b from x group by 1), k as (select z.*, cast(ceil(n/b::double) as bigint) as need from z), t as (select route, n, b, need, j, draw from k, lateral (select unnest(range(1, need+1)) as j), (select unnest(range(1, 5000)) as draw)), u as (select route, draw, {_HEX.format(chr(39) + '0/' + chr(39) + ' || route || ' + chr(39) + '/' + chr(39) + ' || draw || ' + chr(39) + '/' + chr(39) + ' || j')} % (n - b + 1) as a, case when j = need then n - b*(need-1) else b end as l from t), g as (select draw, sum(q.s - p.s) as t from u join p on p.route = u.route and p.i = u.a join p q on q.route = u.route and q.i = u.a + u.l group by 1), m as (select count(*) as n, avg(d) as mean from x) select n, round(mean,6) as mean, round(quantile_cont(t/n, 0.025),6) as low, round(quantile_cont(t/n, 0.975),6) as high from g, m group by n, mean",
)
def e6(spark, d):
    """Interval of the mean loss difference from moving blocks of 48 rows within each series."""
    x = significance.loss_differential(scored(spark, d), "y_30", "p1", "y_persistence")
    return rounded(comparison.block_bootstrap(x, "route", "bin", 48), "mean", "low", "high")


def _days(keys: list[str], source: str = "x") -> str:
    """SQL of the day bootstrap per keys (a list of columns of x)."""
    ks, on = ", ".join(keys), lambda a, b: " and ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    text = " || '/' || ".join(["'0'", *keys, "draw", "j"])
    return (
        f"pd as (select {ks}, day, sum(d) as s, count(d) as c, row_number() over (partition by {ks} order by day) - 1 as i from {source} group by {ks}, day), z as (select {ks}, count(*) as days, cast(sum(c) as bigint) as n, sum(s)/sum(c) as mean from pd group by {ks}), "
        f"t as (select {ks}, days, draw, {_HEX.format(text)} % days as i from z, lateral (select unnest(range(1, days+1)) as j), (select unnest(range(1, 5000)) as draw)), g as (select {', '.join('t.' + k for k in keys)}, draw, sum(s)/sum(c) as m from t join pd on {on('pd', 't')} and pd.i = t.i group by {', '.join('t.' + k for k in keys)}, draw), "
        f"ci as (select {ks}, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from g group by {ks}), res as (select {', '.join('z.' + k for k in keys)}, n, days, mean, low, high from z join ci on {on('z', 'ci')})"
    )


_DECIDE = "case when days >= 10 and high < 0 then 'candidate' when days >= 10 and low > 0 then 'reference' else 'inconclusive' end"


@register("e7_joint_days", f"with {_D}, {_days(['route'])} select route, n, days, round(mean,6) as mean, round(low,6) as low, round(high,6) as high from res")
def e7_days(spark, d):
    x = significance.loss_differential(scored(spark, d), "y_30", "p1", "y_persistence")
    return rounded(comparison.day_bootstrap(x, ["route"], "local_day"), "mean", "low", "high")


@register("e7_day_t", f"with {_D}, p as (select route, day, avg(d) as m from x group by 1, 2) select route, count(m) as days, round(avg(m),6) as mean, round(avg(m)/nullif(stddev_samp(m)/sqrt(count(m)),0),5) as t from p group by 1")
def e7_t(spark, d):
    x = significance.loss_differential(scored(spark, d), "y_30", "p1", "y_persistence")
    return rounded(rounded(comparison.day_t(x, ["route"], "local_day"), "mean"), "t", digits=5)


@register("e7_cluster_t", f"with {_D}, m as (select route, avg(d) as m, count(d) as n from x group by 1), p as (select x.route, day, m, n, sum(d - m) as e from x join m on m.route = x.route group by 1, 2, 3, 4), q as (select route, m, n, count(*) as days, sum(e*e) as v from p group by 1, 2, 3) select route, n, days, round(m,6) as mean, round(m/nullif(sqrt(v*days/nullif(days-1,0))/n,0),5) as t from q")
def e7_cluster(spark, d):
    x = significance.loss_differential(scored(spark, d), "y_30", "p1", "y_persistence")
    return rounded(rounded(comparison.cluster_t(x, ["route"], "local_day"), "mean"), "t", digits=5)


@register("e8_decisions", f"with {_D}, {_days(['route', 'period'])} select route, period, n, days, round(mean,6) as mean, round(low,6) as low, round(high,6) as high, {_DECIDE} as decision from res")
def e8(spark, d):
    """The paired comparison of absolute errors by series and period, with the gate of ten days."""
    return rounded(comparison.compare(scored(spark, d), ["route", "period"], "local_day", "y_30", "p1", "y_persistence"), "mean", "low", "high")


@register("e11_better", f"with {_D}, {_days(['day_type'])} select day_type, days, round(high,6) as high, days >= 3 and high < 0 as better from res")
def e11(spark, d):
    r = comparison.compare(scored(spark, d), ["day_type"], "local_day", "y_30", "p1", "y_persistence")
    return rounded(comparison.better(r).select("day_type", "days", "high", "better"), "high")


_FAM = "f as (select 'headline' as family, 'all' as slice, 'p1' as candidate, 'y_persistence' as reference, day, abs(y_30 - p1) - abs(y_30 - y_persistence) as d from y union all select 'slices', 'period=' || period, 'p1', 'y_persistence', day, abs(y_30 - p1) - abs(y_30 - y_persistence) from y union all select 'slices', 'day_type=' || day_type, 'p1', 'y_persistence', day, abs(y_30 - p1) - abs(y_30 - y_persistence) from y union all select 'reversed', 'route=' || route, 'y_persistence', 'p1', day, abs(y_30 - y_persistence) - abs(y_30 - p1) from y)"


@register("e12_families", f"with {SCORED}, y as (select *, cast(floor((bin*600+28800)/86400) as bigint) as day from sl), {_FAM}, {_days(['family', 'slice', 'candidate', 'reference'], 'f')} select family, slice, candidate, reference, n, days, round(mean,6) as mean, round(low,6) as low, round(high,6) as high, {_DECIDE} as decision from res")
def e12(spark, d):
    """Headline, slice and reversed comparisons in one pass."""
    specs = [("headline", "all", "p1", "y_persistence"), ("slices", "period", "p1", "y_persistence"), ("slices", "day_type", "p1", "y_persistence"), ("reversed", "route", "y_persistence", "p1")]
    return rounded(comparison.families(scored(spark, d), specs, "local_day", "y_30"), "mean", "low", "high")


_LV = "case when {0} < 20 then 'light' when {0} < 35 then 'moderate' else 'heavy' end"


@register("e12_zero_one", f"with {SCORED}, x as (select route, cast(floor((bin*600+28800)/86400) as bigint) as day, cast(({_LV.format('y_30')} <> {_LV.format('p1')})::int - ({_LV.format('y_30')} <> {_LV.format('y_persistence')})::int as double) as d from sl), {_days(['route'])} select route, n, days, round(mean,6) as mean, round(low,6) as low, round(high,6) as high from res")
def e12_zero_one(spark, d):
    """Classes compared by 0/1 loss."""
    level = lambda c: F.when(F.col(c) < 20, "light").when(F.col(c) < 35, "moderate").otherwise("heavy")
    s = scored(spark, d).withColumns({"ly": level("y_30"), "lp": level("p1"), "lr": level("y_persistence")})
    return rounded(comparison.day_bootstrap(comparison.zero_one(s, "ly", "lp", "lr"), ["route"], "local_day"), "mean", "low", "high")


_PV = "t as (select p_type as family, p_brand || p_size as id, pow(least(1.0, avg(p_retailprice)/2000), 12) as p from part group by 1, p_brand, p_size)"


@register("e10_run_wide", f"with {_PV}, o as (select *, row_number() over (partition by family order by p, id) as k, count(*) over (partition by family) as m, row_number() over (order by p, family, id) as ka, count(*) over () as ma from t), a as (select family, least(1.0, max((m-k+1)*p) over (partition by family order by k rows unbounded preceding)) as own, least(1.0, max((ma-ka+1)*p) over (order by ka rows unbounded preceding)) as wide from o) select family, count(*) as tests, count(*) filter (own < 0.05) as within_family, count(*) filter (wide < 0.05) as run_wide from a group by 1")
def e10(spark, d):
    """Tests that stay significant after Holm within families and over the whole run."""
    t = spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_type").alias("family"), "p_brand", "p_size").agg(F.pow(F.least(F.lit(1.0), F.avg("p_retailprice") / 2000), 12).alias("p"))
    return comparison.run_wide(t.select("family", F.concat("p_brand", F.col("p_size").cast("string")).alias("id"), "p"))


@register("m29_substitution", f"with {_D}, {_days(['route'])} select route, round(low,6) as low, round(high,6) as high, case when high < 0 then 'improvement' when low > 0.5 then 'regression' when low >= -0.5 and high <= 0.5 then 'substitute' else 'inconclusive' end as verdict from res")
def m29(spark, d):
    r = comparison.compare(scored(spark, d), ["route"], "local_day", "y_30", "p1", "y_persistence")
    return rounded(comparison.substitution(r).select("route", "low", "high", "verdict"), "low", "high")


@register("m31_fold_deltas", f"with {SCORED}, y as (select sl.*, t.lag_10, cast(floor((sl.bin*600+28800)/86400) as bigint) as day from sl join timed t on t.route = sl.route and t.bin = sl.bin), f as (select route, day, avg((lag_10 is not null)::int) as cover, avg(abs(y_30 - p1)) - avg(abs(y_30 - y_persistence)) as delta from y group by 1, 2) select route, count(*) as folds, count(*) filter (cover >= 0.6) as covered, round(avg(delta) filter (cover >= 0.6),6) as mean, round(avg(delta) filter (cover >= 0.6)/nullif(stddev_samp(delta) filter (cover >= 0.6)/sqrt(count(*) filter (cover >= 0.6)),0),5) as t from f group by 1")
def m31(spark, d):
    """Daily differences of two models on days of which 60 % is covered, and their one-sample t."""
    return rounded(rounded(metrics.fold_deltas(scored(spark, d), "route", "local_day", "y_30", "p1", "y_persistence", "lag_10", 0.6), "mean"), "t", digits=5)


@register("m32_agreement", f"with {SCORED} select route, count(*) as n, round(avg(abs(p1-y_persistence)),6) as mean_abs, round(quantile_cont(abs(p1-y_persistence), 0.95),6) as p95_abs, round(avg(p1-y_persistence),6) as signed, round(corr(p1, y_persistence),6) as correlation from sl group by 1")
def m32(spark, d):
    return rounded(comparison.agreement(scored(spark, d), ["route"], "p1", "y_persistence"), "mean_abs", "p95_abs", "signed", "correlation")


@register("m32_equivalence", f"with {_D}, {_days(['route'])} select route, n, days, round(mean,6) as mean, round(low,6) as low, round(high,6) as high, low > -0.5 and high < 0.5 as equivalent from res")
def m32_equivalence(spark, d):
    """Whether two models' errors differ by less than half a minute, by the interval over days."""
    return rounded(comparison.equivalent(scored(spark, d), ["route"], "local_day", "y_30", "p1", "y_persistence"), "mean", "low", "high")
