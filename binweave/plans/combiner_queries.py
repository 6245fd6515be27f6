"""Queries of the fuzzy rule base over all inputs, stacks, clusterings and ridges of several features, with independent SQL oracles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fuzzy, lags, models, stacks
from .catalog import register
from .series_queries import _HGRID, TIMED, hourly_grid, rounded, timed
from .table_queries import SCORED, scored

_LV = "[{{'k': 'light', 'm': greatest(0.0, least(1.0, (25 - {0})/10))}}, {{'k': 'moderate', 'm': greatest(0.0, least(1.0, ({0} - 15)/10, (40 - {0})/10))}}, {{'k': 'heavy', 'm': greatest(0.0, least(1.0, ({0} - 30)/10))}}]"
_TZ = "greatest(0.0, least(1.0, (h - {0})/({1} - {0}.0), ({3} - h)/({3} - {2}.0)))"
_TIMES = {"morning": _TZ.format(4, 6, 9, 11), "midday": _TZ.format(9, 11, 14, 16), "evening": _TZ.format(14, 16, 20, 23)}
_FX = f"{_HGRID}, fx as (select g.route, cast(g.bin as bigint) as bin, g.y as now, g.y - l.y as trend, ((g.bin*3600 + 1800 + 28800) % 86400)/3600.0 as h, (dayofweek(timestamp '1970-01-01' + to_seconds(cast(g.bin*3600 + 28800 as bigint))) in (0, 6))::int::double as off, coalesce(d.y, g.y) as yesterday, case when a.y < 20 then 0 when a.y < 35 then 1 when a.y is not null then 2 end as class from grid g left join grid l on l.route = g.route and l.bin = g.bin - 6 left join grid d on d.route = g.route and d.bin = g.bin - 24 left join grid a on a.route = g.route and a.bin = g.bin + 1 where g.y is not null and l.y is not null)"
_FIRED = f"tm as (select *, {_TIMES['morning']} as t1, {_TIMES['midday']} as t2, {_TIMES['evening']} as t3 from fx), fired as (select route, bin, now, class, 'now=' || a.k || '|trend=' || b.k || '|time=' || c.k || '|day=' || e.k || '|yesterday=' || f.k as rule, a.m*b.m*c.m*e.m*f.m as s from (select *, unnest({_LV.format('now')}) as a from tm) t1_, lateral (select unnest([{{'k': 'falling', 'm': greatest(0.0, least(1.0, (-1 - trend)/4))}}, {{'k': 'steady', 'm': greatest(0.0, least(1.0, (trend + 5)/4, (5 - trend)/4))}}, {{'k': 'rising', 'm': greatest(0.0, least(1.0, (trend - 1)/4))}}]) as b), lateral (select unnest([{{'k': 'night', 'm': greatest(0.0, least(1.0, 1.0 - t1 - t2 - t3))}}, {{'k': 'morning', 'm': t1}}, {{'k': 'midday', 'm': t2}}, {{'k': 'evening', 'm': t3}}]) as c), lateral (select unnest([{{'k': 'workday', 'm': 1.0 - off}}, {{'k': 'non-workday', 'm': off}}]) as e), lateral (select unnest({_LV.format('yesterday')}) as f) where a.m > 0 and b.m > 0 and c.m > 0 and e.m > 0 and f.m > 0)"
_RULES = "beta as (select rule, class, sum(s) as s from fired where class is not null group by 1, 2), rules as (select rule, cast(arg_max(class, s*1e6 - class) as bigint) as class, (2*max(s) - sum(s))/sum(s) as certainty, sum(s) as support from beta group by 1 having (2*max(s) - sum(s))/sum(s) > 0 and sum(s) >= 2)"


def fuzzy_frame(spark, d) -> tuple[DataFrame, dict]:
    """Hourly rows with the five inputs and the level an hour ahead, and the terms."""
    g = hourly_grid(spark, d).withColumns({"l": lags.at_offset("y", -6), "d1": lags.at_offset("y", -24), "a": lags.at_offset("y", 1)}).filter("y is not null and l is not null")
    dow = F.pmod(F.floor((F.col("bin") * 3600 + 28800) / 86400) + 4, F.lit(7))
    x = g.select("route", "bin", F.col("y").alias("now"), (F.col("y") - F.col("l")).alias("trend"), (F.pmod(F.col("bin") * 3600 + 1800 + 28800, F.lit(86400)) / 3600).alias("h"), dow.isin(0, 6).cast("double").alias("off"), F.coalesce("d1", "y").alias("yesterday"), fuzzy.crisp(F.col("a")).alias("class"))
    return x, fuzzy.antecedents(F.col("now"), F.col("trend"), F.col("h"), F.col("off"), F.col("yesterday"))


@register("m17_partitions", f"with {_FX}, tm as (select *, {_TIMES['morning']} as t1, {_TIMES['midday']} as t2, {_TIMES['evening']} as t3 from fx) select route, bin, round(greatest(0.0, least(1.0, (-1 - trend)/4)),6) as falling, round(greatest(0.0, least(1.0, (trend - 1)/4)),6) as rising, round(greatest(0.0, least(1.0, 1.0 - t1 - t2 - t3)),6) as night, round(t1,6) as morning, round(t2,6) as midday, round(t3,6) as evening, off as nonworkday from tm")
def m17_partitions(spark, d):
    """Degrees of trend, time of day and day type."""
    x, t = fuzzy_frame(spark, d)
    pick = lambda name, *ks: [t[name][k].alias(k) for k in ks]
    out = x.select("route", "bin", *pick("trend", "falling", "rising"), *pick("time", "night", "morning", "midday", "evening"), t["day"]["non-workday"].alias("nonworkday"))
    return rounded(out, "falling", "rising", "night", "morning", "midday", "evening")


@register("m18_rule_base", f"with {_FX}, {_FIRED}, {_RULES} select rule, class, round(certainty,6) as certainty, round(support,6) as support from rules")
def m18_base(spark, d):
    """The rules of all five inputs: 216 antecedents, of which those fire that the rows reach."""
    x, t = fuzzy_frame(spark, d)
    out = fuzzy.rule_base(x, t, "class")
    return rounded(out.withColumn("class", F.col("class").cast("long")), "certainty", "support")


@register("m18_rule_classes", f"with {_FX}, {_FIRED}, {_RULES}, act as (select f.route, f.bin, r.class, max(f.s * r.certainty) as w from fired f join rules r on r.rule = f.rule group by 1, 2, 3), best as (select route, bin, cast(arg_max(class, w*1e9 - class) as bigint) as class, max(w) as w from act group by 1, 2) select fx.route, fx.bin, coalesce(best.class, case when now < 20 then 0 when now < 35 then 1 else 2 end) as predicted, round(best.w,6) as score from fx left join best on best.route = fx.route and best.bin = fx.bin")
def m18_classes(spark, d):
    x, t = fuzzy_frame(spark, d)
    out = fuzzy.scored_classes(x, t, fuzzy.rule_base(x, t, "class"), ["route", "bin"], F.col("now"))
    return rounded(out.withColumn("predicted", F.col("predicted").cast("long")), "score")


def _stack(gates: dict[str, str], digits: int = 6) -> str:
    """SQL of the pair stack of p1 and y_persistence with gates (name -> expression)."""
    g = ", ".join(f"{{'g': '{k}', 'd': {v}}}" for k, v in gates.items())
    w = lambda k: f"case when days >= 2 then coalesce(max(w) filter (gate = '{k}'), 0.5) else 0.5 end as w_{k}"
    value = " + ".join(f"({v})*(p1*coalesce(w_{k}, 0.5) + y_persistence*(1 - coalesce(w_{k}, 0.5)))" for k, v in gates.items())
    return (
        f"with {SCORED}, x as (select *, cast(floor((bin*600+28800)/86400) as bigint) as day from sl), n as (select route, day, day + k as f, p1 - y_persistence as dx, y_30 - y_persistence as dy, unnest([{g}]) as g from x, (select unnest(range(1, 8)) as k)), dd as (select route, f, count(distinct day) as days from n group by 1, 2), "
        "pt as (select route, f, g.g as gate, dy/dx as r, abs(dx)*g.d as v from n where dx <> 0 and g.d > 0), run as (select *, sum(v) over (partition by route, f, gate order by r) as c, sum(v) over (partition by route, f, gate) as t from pt), b as (select route, f, gate, greatest(0.0, least(1.0, min(r))) as w from run where c >= t/2 group by 1, 2, 3), "
        f"ft as (select dd.route, dd.f, {', '.join(w(k) for k in gates)} from dd left join b on b.route = dd.route and b.f = dd.f group by dd.route, dd.f, days) select x.route, x.bin, round({value},{digits}) as stack from x left join ft on ft.route = x.route and ft.f = x.day"
    )


@register("m13_pair_stack", _stack({"one": "1.0"}))
def m13_pair(spark, d):
    """The exact convex stack of two members on the week before each day, equal weights with fewer than two days."""
    return rounded(fuzzy.pair_stack(scored(spark, d), "p1", "y_persistence", "y_30", "route", "local_day").select("route", "bin", "stack"), "stack")


@register("m13_gated_stack", _stack({"light": "greatest(0.0, least(1.0, (25 - y_persistence)/10))", "moderate": "greatest(0.0, least(1.0, (y_persistence - 15)/10, (40 - y_persistence)/10))", "heavy": "greatest(0.0, least(1.0, (y_persistence - 30)/10))"}, 9))
def m13_gated(spark, d):
    """The same with a weight for each level, mixed by its degrees."""
    s = scored(spark, d).withColumns(models.levels(F.col("y_persistence")))
    return rounded(fuzzy.pair_stack(s, "p1", "y_persistence", "y_30", "route", "local_day", gates=["light", "moderate", "heavy"]).select("route", "bin", "stack"), "stack", digits=9)


def four_members(spark, d) -> tuple[DataFrame, list[str]]:
    """Labelled bins with four causal members: persistence, its mean with the value before, the last hour's mean, and the mean of all labels known."""
    s = scored(spark, d).withColumns({"known": stacks.known_day(F.col("bin")), "hour_mean": F.coalesce("roll_mean_60", "y_persistence")})
    s = models.fold_means(s, "route", "y_30").withColumn("train_mean", F.coalesce("train_mean", "y_persistence"))
    return s, ["y_persistence", "p1", "hour_mean", "train_mean"]


_KNOWN = "cast(floor((bin*600+2400+28799)/86400) as bigint)"


@register(
    "m13_stack_losses",
    f"with {SCORED}, x as (select route, y_30 as y, y_persistence as a, p1 as b, cast(floor((bin*600+28800)/86400) as bigint) as day, {_KNOWN} as known from sl), f as (select distinct route, day from x), n as (select f.route, f.day, x.day as own, y, a, b from f join x on x.route = f.route and x.known < f.day), c as (select route, day, count(distinct own) as fit_days from n group by 1, 2 having count(distinct own) >= 2), "
    "pt as (select route, day, (y - b)/(a - b) as r, abs(a - b) as v from n where a <> b), run as (select *, sum(v) over (partition by route, day order by r) as c, sum(v) over (partition by route, day) as t from pt), w as (select route, day, greatest(0.0, least(1.0, min(r))) as w from run where c >= t/2 group by 1, 2) "
    "select n.route, n.day, fit_days, count(*) as n, round(avg(abs(y - a*coalesce(w, 0.5) - b*(1 - coalesce(w, 0.5)))),7) as loss from n join c on c.route = n.route and c.day = n.day left join w on w.route = n.route and w.day = n.day group by 1, 2, 3",
)
def m13_losses(spark, d):
    """The least mean absolute error that any convex mix of two members reaches on all that was known before each day; SQL has it as a weighted median."""
    s = scored(spark, d).withColumn("known", stacks.known_day(F.col("bin")))
    fits = stacks.fitted_days(s, ["y_persistence", "p1"], "y_30", "route", "local_day", "known")
    return rounded(fits.filter("fit_days >= 2").select("route", F.col("local_day").alias("day"), "fit_days", "n", (F.col("loss") / F.col("n")).alias("loss")), "loss", digits=7)


@register("m13_stack")
def m13(spark, d):
    """The rolling convex stack of four members over all that was known before each day; exact, tests certify the optimum."""
    s, members = four_members(spark, d)
    return stacks.stacked(s, members, "y_30", "route", "local_day", "known").select("route", "bin", "stack")


@register("m13_stack_gated")
def m13_four_gated(spark, d):
    """The same with weights for each of three levels of the present value, mixed by its degrees."""
    s, members = four_members(spark, d)
    s = s.withColumns(models.levels(F.col("y_persistence")))
    return stacks.stacked(s, members, "y_30", "route", "local_day", "known", ["light", "moderate", "heavy"]).select("route", "bin", "stack")


@register("m12_certificates")
def m12_certificates(spark, d):
    """Weights, loss and certified lower bound of every fit of the gated stack, in thousandths of the loss."""
    s, members = four_members(spark, d)
    fits = stacks.fitted_days(s.withColumns(models.levels(F.col("y_persistence"))), members, "y_30", "route", "local_day", "known", ["light", "moderate", "heavy"])
    return fits.withColumn("certified", F.col("loss") - F.col("bound") <= 1e-6 * (1 + F.abs("loss")))


@register("m19_validity", f"with {SCORED}, c as (select [[10.0, 10.0], [30.0, 30.0], [60.0, 60.0]] as c), q as (select list_transform(c, lambda p: 1e-12 + (y_30 - p[1])*(y_30 - p[1]) + (y_persistence - p[2])*(y_persistence - p[2])) as d from sl, c), u as (select d, list_transform(d, lambda v: (1/v)/list_sum(list_transform(d, lambda w: 1/w))) as u from q) select count(*) as n, round(avg(list_sum(list_transform(u, lambda v: v*v))),6) as coefficient, round(-avg(list_sum(list_transform(u, lambda v: v*ln(v)))),6) as entropy, round(sum(u[1]*u[1]*d[1] + u[2]*u[2]*d[2] + u[3]*u[3]*d[3])/count(*)/800,6) as xie_beni from u")
def m19_validity(spark, d):
    """Validity of memberships in given centres."""
    s = scored(spark, d).select("y_30", "y_persistence")
    return rounded(fuzzy.validity(s, ["y_30", "y_persistence"], np.array([[10.0, 10.0], [30.0, 30.0], [60.0, 60.0]])), "coefficient", "entropy", "xie_beni")


@register("m19_level_memberships", f"with {SCORED}, u as (select route, bin, y_30 as x, 1/(1e-12+(y_30-10)*(y_30-10)) as a, 1/(1e-12+(y_30-30)*(y_30-30)) as b, 1/(1e-12+(y_30-60)*(y_30-60)) as c from sl) select route, bin, round(case when x <= 10 then 1.0 when x >= 60 then 0.0 else a/(a+b+c) end,6) as low, round(case when x <= 10 then 0.0 when x >= 60 then 0.0 else b/(a+b+c) end,6) as mid, round(case when x <= 10 then 0.0 when x >= 60 then 1.0 else c/(a+b+c) end,6) as high from u")
def m19_levels(spark, d):
    u = fuzzy.level_memberships(F.col("y_30"), [10.0, 30.0, 60.0])
    return rounded(scored(spark, d).select("route", "bin", *(v.alias(n) for n, v in zip(("low", "mid", "high"), u, strict=True))), "low", "mid", "high")


@register("m19_restarts")
def m19_restarts(spark, d):
    """Centres by the best of five starts; held against NumPy in the tests."""
    s = scored(spark, d).select("y_30", "y_persistence")
    centres, objective = fuzzy.restarts(s, ["y_30", "y_persistence"], 3)
    return spark.createDataFrame([(i, float(a), float(b), float(objective)) for i, (a, b) in enumerate(centres)], "cluster int, y_30 double, y_persistence double, objective double")


@register("m2_ridge_two", f"with {TIMED}, i as (select route, bin, y_30 as y, y_persistence as a, coalesce(roll_mean_60, avg(roll_mean_60) over (), 0) as b from timed where y_30 is not null), m as (select route, count(*) as n, avg(y) as my, avg(a) as ma, avg(b) as mb, stddev_pop(a) as sa, stddev_pop(b) as sb, covar_pop(a, b) as cab, covar_pop(a, y) as cay, covar_pop(b, y) as cby from i group by 1), z as (select *, case when sa > 0 then sa else 1 end as ta, case when sb > 0 then sb else 1 end as tb from m), k as (select *, n*sa*sa/(ta*ta) + 0.1 as p, n*cab/(ta*tb) as q, n*sb*sb/(tb*tb) + 0.1 as r, n*cay/ta as u, n*cby/tb as v from z), w as (select route, my, ma, mb, (r*u - q*v)/(p*r - q*q)/ta as wa, (p*v - q*u)/(p*r - q*q)/tb as wb from k) select i.route, i.bin, round(my + wa*(a - ma) + wb*(b - mb),5) as ridge from i join w on w.route = i.route")
def m2_two(spark, d):
    """Ridge of two features, missing values by the mean, alpha 0.1, per series."""
    t = models.mean_imputed(timed(spark, d).filter("y_30 is not null"), ["roll_mean_60"])
    return rounded(models.with_ridge(t, ["y_persistence", "roll_mean_60"], "y_30", "route", 0.1).select("route", "bin", "ridge"), "ridge", digits=5)


def _filtered(x: str, size: int, taps: list[str]) -> str:
    """SQL of one periodised filter step over a list: four taps from 2 k - 1 on."""
    return f"list_transform(range({size // 2}), lambda k: " + " + ".join(f"{t}*{x}[((2*k + {size - 1 + i}) % {size}) + 1]" for i, t in enumerate(taps)) + ")"


#: The db2 filter by its closed form, and its mirror.
_LOW = [f"({v})/(4*sqrt(2.0))" for v in ("1 + sqrt(3.0)", "3 + sqrt(3.0)", "3 - sqrt(3.0)", "1 - sqrt(3.0)")]
_HIGH = [v if i % 2 == 0 else f"-{v}" for i, v in enumerate(_LOW[::-1])]


@register(
    "w18_coefficients",
    f"with {_HGRID}, w as (select a.route, a.bin, list(b.y order by b.bin) as x from grid a join grid b on b.route = a.route and b.bin between a.bin - 35 and a.bin where b.y is not null group by 1, 2 having count(b.y) = 36), m as (select *, list_avg(x) as mean, list_stddev_pop(x) as sd from w), "
    f"z as (select *, list_transform(x, lambda v: case when sd > 0 then (v - mean)/sd else 0 end) as z from m), one as (select *, {_filtered('z', 36, _LOW)} as a1, {_filtered('z', 36, _HIGH)} as d1 from z), two as (select *, {_filtered('a1', 18, _LOW)} as a2, {_filtered('a1', 18, _HIGH)} as d2 from one), "
    "long as (select route, bin, unnest(list_concat(['dwt_mean', 'dwt_std'], list_transform(range(9), lambda i: 'dwt_a_' || i), list_transform(range(9), lambda i: 'dwt_d2_' || i), list_transform(range(18), lambda i: 'dwt_d1_' || i))) as name, unnest(list_concat([mean, sd], a2, d2, d1)) as value from two) select route, cast(bin as bigint) as bin, name, round(value,6) + 0.0 as value from long",
)
def w18_coefficients(spark, d):
    """Mean, deviation and wavelet coefficients of each complete window of 36 bins, one to a row; SQL filters the windows step by step."""
    from ..operators import shaping

    x = shaping.wavelet_features(hourly_grid(spark, d))
    names = F.array(*map(F.lit, ["dwt_mean", "dwt_std", *shaping.wavelet_names(36)]))
    out = x.select("route", "bin", F.explode(F.arrays_zip(names.alias("name"), F.concat(F.array("dwt_mean", "dwt_std"), "coefficients").alias("value"))).alias("_x")).select("route", "bin", "_x.*")
    return rounded(out, "value").withColumn("value", F.col("value") + 0.0)


@register("w20_fallback", f"with {_HGRID}, z as (select *, case when bin % 3 = 0 then y * 2 end as z from grid), s as (select a.route, a.bin, count(b.y) as c, sum(b.y) as first, sum(coalesce(b.z, b.y) * (b.bin - a.bin + 6)) as second from z a join z b on b.route = a.route and b.bin between a.bin - 5 and a.bin group by 1, 2) select route, cast(bin as bigint) as bin, round(first,6) as first, round(second,6) as second from s where c = 6")
def w20_fallback(spark, d):
    """Sequence tensors of two channels, the second with gaps that the first fills; shown by a sum of each."""
    from ..operators import shaping

    g = hourly_grid(spark, d).withColumn("z", F.when(F.col("bin") % 3 == 0, F.col("y") * 2))
    t = shaping.tensors(g, 6, ["y", "z"])
    total = lambda c, w: F.aggregate(F.zip_with("tensor", F.array(*map(F.lit, w)), lambda r, v: r[c] * v), F.lit(0.0), lambda a, v: a + v)
    return rounded(t.select("route", "bin", total(0, [1.0] * 6).alias("first"), total(1, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]).alias("second")), "first", "second")
