"""Error metrics, slices by CUBE and GROUPING SETS, regimes, confusion and correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import mean_ranks, quantiles


def error(actual: str = "actual", predicted: str = "predicted") -> Column:
    return F.col(predicted) - F.col(actual)


def mae(e: Column) -> Column:
    return F.avg(F.abs(e))


def rmse(e: Column) -> Column:
    return F.sqrt(F.avg(e * e))


def cube_scores(rows: DataFrame, a: str, b: str) -> DataFrame:
    """MAE and RMSE over both dimensions and their roll-ups, called all."""
    e = error()
    out = rows.cube(a, b).agg(F.count("*").alias("n"), mae(e).alias("mae"), rmse(e).alias("rmse"), F.grouping(a).alias("_a"), F.grouping(b).alias("_b"))
    return out.select(F.when(F.col("_a") == 1, "all").otherwise(F.col(a)).alias(a), F.when(F.col("_b") == 1, "all").otherwise(F.col(b)).alias(b), "n", "mae", "rmse")


def slice_scores(rows: DataFrame, key: str, dimensions: list[str], candidates: list[str], actual: str = "actual") -> DataFrame:
    """Every candidate over key (and all keys) by all rows and by each value of one dimension: one expand, one shuffle. Null keys and values stand as such."""
    long = rows.unpivot([key, *dimensions, actual], candidates, "candidate", "predicted")
    e = F.col("predicted") - F.col(actual)
    sets = [["candidate", *k, *d] for k in ([key], []) for d in ([], *([x] for x in dimensions))]
    up = [F.grouping(c).alias(f"_up_{c}") for c in (key, *dimensions)]
    out = long.groupingSets([[F.col(c) for c in s] for s in sets], "candidate", key, *dimensions).agg(F.count("*").alias("n"), mae(e).alias("mae"), rmse(e).alias("rmse"), *up)
    slice_ = F.coalesce(*(F.when(F.col(f"_up_{d}") == 0, F.concat_ws("=", F.lit(d), F.col(d))) for d in dimensions), F.lit("all"))
    return out.select("candidate", F.when(F.col(f"_up_{key}") == 1, "both").otherwise(F.col(key)).alias(key), slice_.alias("slice"), "n", "mae", "rmse")


def step_scores(rows: DataFrame, steps: dict[int, str], models: list[str], dimensions: list[str], half_width: float) -> DataFrame:
    """Every model at every step over all rows and by each value of one dimension: (model, step, grp, n, mae, rmse, coverage). steps: minutes -> actual column.

    coverage: the share of actuals within half_width of the prediction. One expand to (step, model), one of grouping sets, one shuffle.
    """
    pairs = F.array(*(F.struct(F.lit(k).alias("step"), F.col(c).alias("actual"), F.lit(m).alias("model"), F.col(m).alias("p")) for k, c in steps.items() for m in models))
    long = rows.select(*dimensions, F.explode(pairs).alias("_x")).select(*dimensions, "_x.*").filter("actual is not null and p is not null")
    e = F.col("p") - F.col("actual")
    sets = [["model", "step", *d] for d in ([], *([x] for x in dimensions))]
    out = long.groupingSets([[F.col(c) for c in s] for s in sets], "model", "step", *dimensions).agg(F.count("*").alias("n"), mae(e).alias("mae"), rmse(e).alias("rmse"), F.avg((F.abs(e) <= half_width).cast("double")).alias("coverage"), *(F.grouping(c).alias(f"_up_{c}") for c in dimensions))
    grp = F.coalesce(*(F.when(F.col(f"_up_{d}") == 0, F.concat_ws("=", F.lit(d), F.col(d))) for d in dimensions), F.lit("all"))
    return out.select("model", "step", grp.alias("grp"), "n", "mae", "rmse", "coverage")


def error_metrics(rows: DataFrame, keys: list[str], within: float = 15.0) -> DataFrame:
    """Count, MAE, median and 90th percentile of the absolute error (interpolated), RMSE, bias, share within the bound."""
    e = error()
    x = F.abs(e)
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), mae(e).alias("mae"), rmse(e).alias("rmse"), F.avg(e).alias("bias"), F.avg((x <= within).cast("double")).alias("share_within"))
    parts = quantiles(rows.withColumn("_ae", x), keys, {"median_ae": ("_ae", 0.5), "p90_ae": ("_ae", 0.9)})
    both = sums.alias("s").join(parts.alias("q"), [F.col(f"s.{k}").eqNullSafe(F.col(f"q.{k}")) for k in keys] or F.lit(True))
    return both.select(*(f"s.{k}" for k in keys), "n", "mae", "median_ae", "p90_ae", "rmse", "bias", "share_within")


def regime_shares(rows: DataFrame, regime: str = "regime") -> DataFrame:
    """Each regime's share of the rows and of the summed absolute error."""
    g = rows.groupBy(regime).agg(F.count("*").alias("n"), F.sum(F.abs(error())).alias("ae"))
    every = Window.partitionBy(F.lit(1))  # one row per regime
    return g.select(regime, "n", (F.col("n") / F.sum("n").over(every)).alias("row_share"), (F.col("ae") / F.sum("ae").over(every)).alias("error_share"))


def coverage(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Share of non-null values of each column and key."""
    return rows.groupBy(key).agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns)).unpivot([key], columns, "feature", "coverage")


def confusion(rows: DataFrame, y: str, p: str) -> DataFrame:
    return rows.groupBy(y, p).agg(F.count("*").alias("n"))


def classification(counts: DataFrame, y: str, p: str, classes: list[str]) -> DataFrame:
    """Accuracy, macro F1 over classes that occur, and the share of errors by two levels or more, from a confusion table."""
    level = lambda c: F.array_position(F.array(*(F.lit(x) for x in classes)), F.col(c))
    sums = {"total": F.sum("n"), "right": F.sum(F.when(F.col(y) == F.col(p), F.col("n")).otherwise(0)), "severe": F.sum(F.when(F.abs(level(y) - level(p)) >= 2, F.col("n")).otherwise(0))}
    for i, c in enumerate(classes):
        sums |= {f"tp{i}": F.sum(F.when((F.col(y) == c) & (F.col(p) == c), F.col("n")).otherwise(0)), f"t{i}": F.sum(F.when(F.col(y) == c, F.col("n")).otherwise(0)), f"p{i}": F.sum(F.when(F.col(p) == c, F.col("n")).otherwise(0))}
    one = counts.agg(*(v.alias(k) for k, v in sums.items()))
    f1 = [F.when(F.col(f"t{i}") + F.col(f"p{i}") > 0, 2.0 * F.col(f"tp{i}") / (F.col(f"t{i}") + F.col(f"p{i}"))) for i in range(len(classes))]
    there = [F.when(x.isNotNull(), 1).otherwise(0) for x in f1]
    macro = sum((F.coalesce(x, F.lit(0.0)) for x in f1), F.lit(0.0)) / sum(there, F.lit(0))
    return one.select(F.col("total").alias("n"), (F.col("right") / F.col("total")).alias("accuracy"), macro.alias("macro_f1"), (F.col("severe") / F.col("total")).alias("severe_rate"))


def ranked_probability(probabilities: list[str], level: str) -> Column:
    """Ranked probability score of one row: squared differences of cumulative probabilities, over classes less one. level: 0, 1, ..."""
    run, total = F.lit(0.0), F.lit(0.0)
    for i, c in enumerate(probabilities[:-1]):
        run = run + F.col(c)
        total = total + F.pow(run - (F.col(level) <= i).cast("double"), 2)
    return total / (len(probabilities) - 1)


def correlations(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Pearson and Spearman (correlation of mean ranks) by key."""
    both = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, x, y)
    rank = lambda c: mean_ranks(both, [key], c).select(F.col(key).alias("_k"), F.col(c).alias("_v"), F.col("rank").alias(f"_r{c}"))
    for c in (x, y):
        both = both.join(rank(c), F.col(key).eqNullSafe(F.col("_k")) & (F.col(c).cast("double") == F.col("_v"))).drop("_k", "_v")
    return both.groupBy(key).agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr(f"_r{x}", f"_r{y}").alias("spearman"))


def recalls(counts: DataFrame, y: str, p: str) -> DataFrame:
    """Rows and recall of each class, from a confusion table."""
    return counts.groupBy(F.col(y).alias("class")).agg(F.sum("n").alias("n"), (F.sum(F.when(F.col(y) == F.col(p), F.col("n")).otherwise(0)) / F.sum("n")).alias("recall"))


def count_errors(rows: DataFrame, part: str, y: str, p: str) -> DataFrame:
    """Errors of counts over each part and all: n, MAE and bias to two decimals, exact, within two."""
    e = F.col(p) - F.col(y)
    both = rows.select(F.explode(F.array(F.col(part), F.lit("all"))).alias(part), e.alias("e"))
    return both.groupBy(part).agg(F.count("*").alias("n"), F.round(F.avg(F.abs("e")), 2).alias("mae"), F.round(F.avg("e"), 2).alias("bias"), F.avg((F.col("e") == 0).cast("double")).alias("exact"), F.avg((F.abs("e") <= 2).cast("double")).alias("within_2"))


def day_summary(bins: DataFrame, key: str, day: str, least: int) -> DataFrame:
    """Per key: days, days of at least that many bins, and the bins of those."""
    per = bins.groupBy(key, day).agg(F.count("*").alias("c"))
    full = F.col("c") >= least
    return per.groupBy(key).agg(F.count("*").alias("days"), F.count_if(full).alias("kept_days"), F.coalesce(F.sum(F.when(full, F.col("c"))), F.lit(0)).alias("kept_bins"))


def day_coverage(rows: DataFrame, order: list[str], offset_s: int = 28800) -> DataFrame:
    """rows(bin, status): per local day the recorded bins, and those whose latest status by the order is ok."""
    newest = rows.groupBy("bin").agg(F.max_by("status", F.struct(*order)).alias("status"))
    return newest.groupBy(F.floor((F.col("bin") * 600 + offset_s) / 86400).cast("long").alias("local_day")).agg(F.count("*").alias("recorded"), F.count_if(F.col("status") == "ok").alias("ok"))


def mean_of_days(rows: DataFrame, day: str, actual: str, methods: list[str]) -> DataFrame:
    """Per method the mean of its daily mean absolute errors."""
    per = rows.groupBy(day).agg(*(F.avg(F.abs(F.col(m) - F.col(actual))).alias(m) for m in methods))
    return per.unpivot([day], methods, "method", "_e").groupBy("method").agg(F.count("_e").alias("days"), F.avg("_e").alias("mae"))


def threshold_sweep(matches: DataFrame, truths: DataFrame, thresholds: list[float]) -> DataFrame:
    """matches(cls, confidence, hit) at every least confidence: kept, hits, precision, recall, F1 and the ratio of counts; counts by confidence are made first."""
    steps = matches.groupBy("cls", "confidence").agg(F.count("*").alias("n"), F.count_if("hit").alias("h"))
    each = steps.withColumn("least", F.explode(F.array(*map(F.lit, thresholds))))
    ok = F.col("confidence") >= F.col("least")
    sums = each.groupBy("cls", "least").agg(F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("kept"), F.sum(F.when(ok, F.col("h")).otherwise(0)).alias("hits"))
    both = sums.join(truths.groupBy("cls").agg(F.count("*").alias("truths")), "cls")
    return both.select("cls", "least", "kept", "hits", F.try_divide("hits", "kept").alias("precision"), F.try_divide("hits", "truths").alias("recall"), F.try_divide(2 * F.col("hits"), F.col("kept") + F.col("truths")).alias("f1"), F.try_divide("kept", "truths").alias("ratio"))


def fold_deltas(rows: DataFrame, key: str, day: str, actual: str, candidate: str, reference: str, covered: str, least: float) -> DataFrame:
    """Per key: daily folds, those with at least that share of `covered` non-null, the mean of their error differences and its t statistic."""
    err = lambda c: F.avg(F.abs(F.col(actual) - F.col(c)))
    folds = rows.groupBy(key, day).agg(F.avg(F.col(covered).isNotNull().cast("double")).alias("_c"), (err(candidate) - err(reference)).alias("_d"))
    d = F.when(F.col("_c") >= least, F.col("_d"))
    return folds.groupBy(key).agg(F.count("*").alias("folds"), F.count(d).alias("covered"), F.avg(d).alias("mean"), F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count(d))).alias("t"))
