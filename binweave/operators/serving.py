"""Serving decisions: origins, expiry, decision rules, forecast curves, fallbacks, registry and payload rules, all as columns of DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def servable_origins(bins: DataFrame, now_s: int, most_age_s: int, key: str = "route", width_s: int = 600) -> DataFrame:
    """The newest bin of each series, and servable: it ended at most most_age_s ago and no gap lies shortly before."""
    newest = bins.groupBy(key).agg(F.max_by(F.struct("bin", "y", "after_gap"), "bin").alias("_o")).select(key, "_o.*")
    age = F.lit(now_s) - (F.col("bin") + 1) * width_s
    return newest.withColumn("servable", (age <= most_age_s) & (F.col("after_gap") == 0))


def unexpired(forecasts: DataFrame, now_s: int | Column, target: str = "target_s") -> DataFrame:
    """Forecasts whose target bin has not begun."""
    return forecasts.filter(F.col(target) > (F.lit(now_s) if isinstance(now_s, int) else now_s))


def predicted_at(rows: DataFrame, model: str, twin: str) -> DataFrame:
    """A model's and its twin's predictions on the same rows: both null after a gap or where either is missing."""
    ok = (F.col("after_gap") == 0) & F.col(model).isNotNull() & F.col(twin).isNotNull()
    return rows.withColumns({model: F.when(ok, F.col(model)), twin: F.when(ok, F.col(twin))})


def decision_rules(scores: DataFrame, least_coverage: float = 0.5) -> DataFrame:
    """serve and use_counts of each direction and step.

    scores(mae, persistence_mae, fallback_mae, counts_mae, counts_twin_mae, coverage): the variant with counts is used where they
    cover enough rows and it beats both its twin on the same rows and the fallback; the candidate is served only if it beats persistence.
    """
    use = F.coalesce((F.col("coverage") >= least_coverage) & (F.col("counts_mae") < F.col("counts_twin_mae")) & (F.col("counts_mae") < F.col("fallback_mae")), F.lit(False))
    own = F.when(use, F.col("counts_mae")).otherwise(F.col("mae"))
    return scores.withColumns({"use_counts": use, "serve": F.when(F.coalesce(own < F.col("persistence_mae"), F.lit(False)), F.when(use, "counts").otherwise("model")).otherwise("persistence")})


def served(rows: DataFrame, decisions: DataFrame, keys: list[str], chains: dict[str, list[str]]) -> DataFrame:
    """served and served_by: by each row's decision the first of its chain that isn't null; decisions are a registry of few rows."""
    both = rows.join(F.broadcast(decisions.select(*keys, "serve")), keys, "left")
    pick = lambda f: F.coalesce(*(F.when(F.col("serve") == k, f(chain)) for k, chain in chains.items()))
    return both.withColumns({"served": pick(lambda c: F.coalesce(*c)), "served_by": pick(lambda c: F.coalesce(*(F.when(F.col(x).isNotNull(), F.lit(x)) for x in c)))})


def forecast_curve(origins: DataFrame, profile: DataFrame, model: str = "model", key: str = "route", step_s: int = 1800, span_s: int = 86400, model_s: int = 19800, day_s: int = 86400, offset_s: int = 28800) -> DataFrame:
    """Every step ahead of each origin (key, origin_s, model per series): the model's value up to model_s, the profile's beyond, or throughout where there is no origin value.

    profile(key, slot, profile) is by slots of step_s of the local day.
    """
    points = origins.withColumn("ahead_s", F.explode(F.sequence(F.lit(step_s), F.lit(span_s), F.lit(step_s)))).withColumn("target_s", F.col("origin_s") + F.col("ahead_s"))
    slot = F.floor(F.pmod(F.col("target_s") + offset_s, F.lit(day_s)) / step_s).cast("long")
    both = points.withColumn("slot", slot).join(profile, [key, "slot"], "left")
    near = (F.col("ahead_s") <= model_s) & F.col(model).isNotNull()
    return both.withColumns({"value": F.when(near, F.col(model)).otherwise(F.col("profile")), "source": F.when(near, "model").when(F.col("profile").isNotNull(), "profile")})


def profile_curve(keys: DataFrame, value: Column, key: str = "route", step_min: int = 10) -> DataFrame:
    """A profile, given as an expression of tod_min and is_weekend, over one working and one weekend day."""
    grid = keys.select(key, F.explode(F.array(F.lit(0), F.lit(1))).alias("is_weekend")).withColumn("tod_min", F.explode(F.sequence(F.lit(0), F.lit(1439), F.lit(step_min))))
    return grid.withColumn("profile", value)


def with_profile_deltas(rows: DataFrame, profile: DataFrame, key: str = "route", slot_s: int = 3600, ahead_s: int = 1800, offset_s: int = 28800) -> DataFrame:
    """profile_now, profile_ahead and their difference, of a profile(key, slot, profile) by slots of the local day."""
    slot = lambda t: F.floor(F.pmod(t + offset_s, F.lit(86400)) / slot_s).cast("long")
    start = F.col("bin") * 600
    out = rows.withColumns({"_s0": slot(start), "_s1": slot(start + ahead_s)})
    for n, name in (("_s0", "profile_now"), ("_s1", "profile_ahead")):
        out = out.join(F.broadcast(profile.select(key, F.col("slot").alias(n), F.col("profile").alias(name))), [key, n], "left")  # one row per series and slot
    return out.withColumn("profile_delta", F.col("profile_ahead") - F.col("profile_now")).drop("_s0", "_s1")


def regime_label(level: Column, cuts: tuple[float, float] = (20.0, 35.0), width: float = 5.0) -> Column:
    """The level of largest membership, of equal ones the lowest; null for null."""
    from .models import levels

    m = levels(level, cuts, width)
    best = F.array_max(F.array(*(F.struct(v.alias("m"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, v) in enumerate(m.items()))))
    return F.when(level.isNotNull(), best["k"])


def blend_problem(weights: Column, names: list[str]) -> Column:
    """Why a map of blend weights is no blend: unknown names, values out of 0 to 1, or a sum other than 1; null if it is one."""
    total = F.aggregate(F.map_values(weights), F.lit(0.0), lambda a, v: a + v)
    return (
        F.when(weights.isNull() | (F.size(weights) == 0), "empty")
        .when(F.size(F.array_except(F.map_keys(weights), F.array(*map(F.lit, names)))) > 0, "name")
        .when(F.exists(F.map_values(weights), lambda v: v.isNull() | (v < 0) | (v > 1)), "range")
        .when(F.abs(total - 1) > 1e-6, "sum")
    )


def blended(rows: DataFrame, weights: dict[str, float]) -> Column:
    """The weighted mean of the members that aren't null, the weights renormalised."""
    own = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0)) / F.nullif(own, F.lit(0.0))


def catalogue(spark, models: list[tuple[str, str, list[int], str]]) -> DataFrame:
    """(model, state, horizon, version): one row per model and horizon."""
    rows = spark.createDataFrame(models, "model string, state string, horizons array<int>, version string")
    return rows.select("model", "state", F.explode("horizons").alias("horizon"), "version")


def registry_row(created: Column, model: str, parts: dict[str, Column], config: dict) -> list[Column]:
    """Columns of a registry row: when, which model, its parts as JSON, and its configuration as JSON in a fixed order of keys."""
    return [created.alias("created_at"), F.lit(model).alias("model"), F.to_json(F.struct(*(v.alias(k) for k, v in parts.items()))).alias("parts"), F.lit(json.dumps(config, sort_keys=True)).alias("config")]


def registry_read(registry: DataFrame, model: str, parts: str, config: dict) -> DataFrame:
    """The newest row of a model with its parts read by a schema. drift: its configuration is another; fallback: persistence where a part can't be read."""
    newest = registry.filter(F.col("model") == model).orderBy(F.desc("created_at")).limit(1)
    p = F.from_json("parts", parts)
    names = [x.strip().split()[0] for x in parts.split(",")]
    broken = p.isNull()
    for n in names:
        broken = broken | p[n].isNull()
    return newest.select("created_at", "model", p.alias("parts"), (F.col("config") != json.dumps(config, sort_keys=True)).alias("drift"), F.when(broken, "persistence").alias("fallback"))


def cache_states(entries: DataFrame, now_s: int, ttl_s: int, most_age_s: int) -> DataFrame:
    """state of cached values by their age: fresh within the time to live, stale up to the most age, else expired."""
    age = F.lit(now_s) - F.col("stored_s")
    return entries.withColumns({"age_s": age, "state": F.when(age <= ttl_s, "fresh").when(age <= most_age_s, "stale").otherwise("expired")})


def scoring_status(frames: DataFrame, most_age_s: int = 900) -> DataFrame:
    """status of each bin's frame: missing_frame, stale_frame, invalid_image, error or ok; quota is told apart as an error that stops a run."""
    return frames.withColumn(
        "status",
        F.when(F.col("frame_s").isNull(), "missing_frame").when(F.col("bin_s") - F.col("frame_s") > most_age_s, "stale_frame").when(F.col("bytes") <= 0, "invalid_image").when(F.col("error").rlike("(?i)quota|429"), "quota").when(F.col("error").isNotNull(), "error").otherwise("ok"),
    )


def light_slices(rows: DataFrame, seconds: str = "frame_s", luminance: str = "luminance", dark: float = 60.0, offset_s: int = 28800) -> DataFrame:
    """Rows by light (day from 7 to 19 local time; where there is no time by luminance, else unknown), each also under all."""
    hour = F.floor(F.pmod(F.col(seconds) + offset_s, F.lit(86400)) / 3600)
    light = F.when(F.col(seconds).isNotNull(), F.when(hour.between(7, 18), "day").otherwise("night")).when(F.col(luminance).isNotNull(), F.when(F.col(luminance) < dark, "night").otherwise("day")).otherwise("unknown")
    return rows.withColumn("slice", F.explode(F.array(light, F.lit("all"))))


def fuzzy_inputs(rows: DataFrame, label_s: int = 1800, offset_s: int = 28800) -> DataFrame:
    """now, trend (over six steps), target hour and day-before value (now where there is none) of supervised rows with lag_1 to lag_7."""
    hour = F.floor(F.pmod(F.col("bin") * 600 + label_s + offset_s, F.lit(86400)) / 3600).cast("long")
    return rows.withColumns({"now": F.col("lag_1"), "trend": F.col("lag_1") - F.col("lag_7"), "target_hour": hour, "day_before": F.coalesce("d1", "lag_1")})


def majority(rows: DataFrame, key: str, level: str, order: list[str]) -> DataFrame:
    """Each key's most frequent level, of equal ones the first of the order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(level))
    counts = rows.groupBy(key, level).agg(F.count("*").alias("_c"))
    return counts.groupBy(key).agg(F.max_by(level, F.struct("_c", -place)).alias("majority"))


def covered_metrics(rows: DataFrame, key: str, actual: str, predicted: str, covered: Column, least: float = 0.6) -> DataFrame:
    """MAE over all rows and over covered ones, the coverage, and whether it suffices for a comparison."""
    e = F.abs(F.col(actual) - F.col(predicted))
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg(e).alias("mae_all"), F.avg(F.when(covered, e)).alias("mae_covered"), F.avg(covered.cast("double")).alias("coverage"))
    return out.withColumn("sufficient", F.col("coverage") >= least)


def renamed_stations(readings: DataFrame, names: dict[str, str], station: str = "station") -> DataFrame:
    """Stations under their present names."""
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return readings.withColumn(station, F.coalesce(F.try_element_at(table, F.col(station)), F.col(station)))


def require_no_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, or an error that says how many rows repeat a key."""
    n = df.groupBy(*keys).count().filter("count > 1").agg(F.sum(F.col("count") - 1)).first()[0]
    if n:
        raise ValueError(f"{n} rows repeat {keys}")
    return df


def scaled(rows: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their training mean over their training deviation (1 where that is 0)."""
    s = train.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    return rows.withColumns({c: (F.col(c) - s[f"m_{c}"]) / (s[f"s_{c}"] or 1.0) for c in columns})


def validation_tail(rows: DataFrame, order: list[str], share: float = 0.15, key: str = "route") -> DataFrame:
    """part: the last share of each key's rows in order is val, the rest train."""
    w = Window.partitionBy(key)
    rank = F.row_number().over(w.orderBy(*order))
    return rows.withColumn("_r", rank).withColumn("_n", F.count("*").over(w)).withColumn("part", F.when(F.col("_r") > F.col("_n") - F.floor(F.col("_n") * share), "val").otherwise("train")).drop("_r", "_n")


def day_comparison(points: DataFrame, key: str = "route", t: str = "t", y: str = "y", slot_s: int = 300, day_s: int = 86400) -> DataFrame:
    """Today's observed points and yesterday's by slot of the day (to the nearest slot): the mean of each and their difference. Profile points are left out."""
    own = points.filter(F.coalesce(F.col("source"), F.lit("")) != "profile")
    at = F.floor(F.col(t) / slot_s + 0.5).cast("long")
    per = own.groupBy(key, at.alias("slot")).agg(F.avg(y).alias("y"))
    before = per.select(key, (F.col("slot") + day_s // slot_s).alias("slot"), F.col("y").alias("y_before"))
    return per.join(before, [key, "slot"], "left").withColumn("change", F.col("y") - F.col("y_before"))


def nested_predictions(df: DataFrame, reply: str) -> DataFrame:
    """The list of predictions wherever one of the known places of a reply (JSON text) has it, unfolded: (class, confidence, x, y, width, height)."""
    schema = "array<struct<class:string,confidence:double,x:double,y:double,width:double,height:double>>"
    places = ("$.predictions", "$.outputs[0].predictions", "$.outputs[0].predictions.predictions", "$.result.predictions", "$[0].predictions.predictions", "$[0].predictions")
    found = F.coalesce(*(F.when(F.get_json_object(reply, p).startswith("["), F.get_json_object(reply, p)) for p in places))
    rest = [c for c in df.columns if c != reply]
    return df.select(*rest, F.explode(F.from_json(found, schema)).alias("_p")).select(*rest, "_p.*")


def contiguous(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows, or an error if a group's rows are interrupted by another group's in the overall order, or a time stands twice in a group."""
    spans = rows.groupBy(group).agg(F.min(order).alias("a"), F.max(order).alias("b"), F.count("*").alias("n"), F.count_distinct(order).alias("m"))
    w = Window.orderBy("a", "b")  # one row per group
    bad = spans.withColumn("_before", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))).filter((F.col("a") <= F.col("_before")) | (F.col("n") > F.col("m")))
    if n := bad.count():
        raise ValueError(f"{n} groups overlap others or repeat a time")
    return rows
