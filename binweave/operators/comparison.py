"""Paired comparisons as Spark work: bootstraps by joins of draws with prefix sums, decisions, families and gates.

Random choices are pseudo-random numbers of (seed, group, draw, number), so they are the
same on any cluster and in any plan, and recomputed rows draw the same. What a bootstrap
resamples are blocks of consecutive rows, looked up in prefix sums, or whole days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import quantiles

DRAWS = 4999
#: Distinct days from which a pooled comparison may be decided.
DAYS = 10


def drawn(n: Column, seed: int, *of: Column | str) -> Column:
    """A pseudo-random whole number from 0 to n - 1, by an MD5 of the seed and the columns."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in of))), 1, 8), 16, 10).cast("long") % n


def interval(means: DataFrame, keys: list[str], level: float = 0.95) -> DataFrame:
    a, b = (1 - level) / 2, (1 + level) / 2
    return means.groupBy(*keys).agg(F.percentile("m", a).alias("low"), F.percentile("m", b).alias("high"))


def block_bootstrap(rows: DataFrame, group: str, order: str, block: int, d: str = "d", draws: int = DRAWS, seed: int = 0, level: float = 0.95) -> DataFrame:
    """One row: n, mean, low and high of the mean of d from moving blocks within groups; the last block of a group is cut to its length.

    A group of n rows is met with ceil(n / block) block starts per draw: a table of draws, whose size the blocks bound, not the rows.
    """
    w = Window.partitionBy(group).orderBy(order)
    x = rows.filter(F.col(d).isNotNull()).select(group, order, F.col(d).alias("d"))
    prefix = x.select(group, F.row_number().over(w).cast("long").alias("i"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    prefix = prefix.unionAll(prefix.filter("i = 1").select(group, F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("s")))
    sizes = x.groupBy(group).agg(F.count("*").alias("n")).withColumn("b", F.least(F.lit(block), F.col("n")))
    need = F.ceil(F.col("n") / F.col("b")).cast("int")
    starts = sizes.withColumn("k", F.explode(F.sequence(F.lit(1), need))).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    size = F.when(F.col("k") == need, F.col("n") - F.col("b") * (need - 1)).otherwise(F.col("b"))
    cut = starts.withColumn("at", drawn(F.col("n") - F.col("b") + 1, seed, group, "draw", "k")).select(group, "draw", "at", (F.col("at") + size).alias("end"))
    sums = cut.join(prefix.select(group, F.col("i").alias("at"), F.col("s").alias("s0")), [group, "at"]).join(prefix.select(group, F.col("i").alias("end"), F.col("s").alias("s1")), [group, "end"])
    all_ = x.agg(F.count("*").alias("n"), F.avg("d").alias("mean"))
    means = sums.groupBy("draw").agg(F.sum(F.col("s1") - F.col("s0")).alias("t")).join(F.broadcast(all_)).select((F.col("t") / F.col("n")).alias("m"), "n", "mean")  # one row beside each draw
    return interval(means, ["n", "mean"], level)


def day_bootstrap(rows: DataFrame, keys: list[str], day: str, d: str = "d", draws: int = DRAWS, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Per key: n, days, mean, low and high of the mean of d over whole days drawn with replacement; the sums of a day are all that is resampled."""
    per = rows.filter(F.col(d).isNotNull()).groupBy(*keys, day).agg(F.sum(d).alias("_s"), F.count(d).alias("_c"))
    numbered = per.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(day)).cast("long") - 1)
    sizes = per.groupBy(*keys).agg(F.count("*").alias("days"), F.sum("_c").alias("n"), (F.sum("_s") / F.sum("_c")).alias("mean"))
    picks = sizes.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("days").cast("int")))).withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    picks = picks.withColumn("_i", drawn(F.col("days"), seed, *keys, "_draw", "_k"))
    means = picks.join(numbered.select(*keys, "_i", "_s", "_c"), [*keys, "_i"]).groupBy(*keys, "_draw").agg((F.sum("_s") / F.sum("_c")).alias("m"))
    return sizes.join(interval(means, keys, level), keys).select(*keys, "n", "days", "mean", "low", "high")


def day_t(rows: DataFrame, keys: list[str], day: str, d: str = "d") -> DataFrame:
    """Per key: days, mean of the daily means of d, and its t statistic against zero (days - 1 degrees of freedom), null where it has none."""
    per = rows.groupBy(*keys, day).agg(F.avg(d).alias("m"))
    return per.groupBy(*keys).agg(F.count("m").alias("days"), F.avg("m").alias("mean"), F.try_divide(F.avg("m"), F.stddev_samp("m") / F.sqrt(F.count("m"))).alias("t"))


def cluster_t(rows: DataFrame, keys: list[str], day: str, d: str = "d") -> DataFrame:
    """Per key: the t statistic of the mean of d whose variance sums squares of daily sums of deviations, with the factor days / (days - 1)."""
    mean = rows.groupBy(*keys).agg(F.avg(d).alias("_m"), F.count(d).alias("_n"))
    own = rows.select(*keys, day, d).join(mean, keys).groupBy(*keys, day, "_m", "_n").agg(F.sum(F.col(d) - F.col("_m")).alias("_e"))
    out = own.groupBy(*keys, "_m", "_n").agg(F.count("*").alias("days"), F.sum(F.col("_e") * F.col("_e")).alias("_v"))
    error = F.sqrt(F.col("_v") * F.col("days") / (F.col("days") - 1)) / F.col("_n")
    return out.select(*keys, F.col("_n").alias("n"), "days", F.col("_m").alias("mean"), F.when(F.col("days") > 1, F.try_divide("_m", error)).alias("t"))


def decided(results: DataFrame, least_days: int = DAYS) -> DataFrame:
    """decision: candidate or reference where the interval lies on one side and the days suffice, else inconclusive."""
    enough = F.col("days") >= least_days
    return results.withColumn("decision", F.when(enough & (F.col("high") < 0), "candidate").when(enough & (F.col("low") > 0), "reference").otherwise("inconclusive"))


def compare(rows: DataFrame, keys: list[str], day: str, actual: str, candidate: str, reference: str, least_days: int = DAYS, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """Per key the paired comparison of absolute errors: n, days, mean difference, interval over days, decision."""
    d = F.abs(F.col(actual) - F.col(candidate)) - F.abs(F.col(actual) - F.col(reference))
    return decided(day_bootstrap(rows.withColumn("d", d), keys, day, draws=draws, seed=seed), least_days)


def families(rows: DataFrame, specs: list[tuple[str, str, str, str]], day: str, actual: str, least_days: int = DAYS, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """Comparisons of several families in one pass. specs: (family, slice column or 'all', candidate, reference) -> family, slice, candidate, reference, and compare's columns.

    Rows are unfolded once per spec; days are aggregated before anything is resampled.
    """
    row = lambda f, c, a, b: F.struct(F.lit(f).alias("family"), (F.lit("all") if c == "all" else F.concat_ws("=", F.lit(c), F.col(c))).alias("slice"), F.lit(a).alias("candidate"), F.lit(b).alias("reference"), (F.abs(F.col(actual) - F.col(a)) - F.abs(F.col(actual) - F.col(b))).alias("d"))
    long = rows.select(day, F.explode(F.array(*(row(*s) for s in specs))).alias("_x")).select(day, "_x.*")
    return decided(day_bootstrap(long, ["family", "slice", "candidate", "reference"], day, draws=draws, seed=seed), least_days)


def zero_one(rows: DataFrame, actual: str, candidate: str, reference: str) -> DataFrame:
    """d: 1 where only the candidate's class is wrong, -1 where only the reference's is."""
    return rows.withColumn("d", (F.col(actual) != F.col(candidate)).cast("double") - (F.col(actual) != F.col(reference)).cast("double"))


def better(results: DataFrame, least_days: int = 3) -> DataFrame:
    """better: the interval's high end is below zero over enough days."""
    return results.withColumn("better", (F.col("days") >= least_days) & (F.col("high") < 0))


def run_wide(tests: DataFrame, family: str = "family", p: str = "p", level: float = 0.05) -> DataFrame:
    """Per family: tests, those significant after Holm within the family, and after Holm over the whole run."""
    from .significance import holm

    own = holm(tests, [family], p).withColumnRenamed("adjusted", "_own").drop("family_size")
    both = holm(own, None, p).withColumnRenamed("adjusted", "_all")
    return both.groupBy(family).agg(F.count("*").alias("tests"), F.count_if(F.col("_own") < level).alias("within_family"), F.count_if(F.col("_all") < level).alias("run_wide"))


def agreement(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Per key: n, mean and 95th percentile of the absolute difference of two predictions, mean signed difference and correlation."""
    e = F.col(a) - F.col(b)
    both = rows.filter(e.isNotNull())
    sums = both.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mean_abs"), F.avg(e).alias("signed"), F.corr(a, b).alias("correlation"))
    high = quantiles(both.withColumn("_ae", F.abs(e)), keys, {"p95_abs": ("_ae", 0.95)})
    return sums.alias("s").join(high.alias("q"), [F.col(f"s.{k}").eqNullSafe(F.col(f"q.{k}")) for k in keys]).select(*(f"s.{k}" for k in keys), "n", "mean_abs", "p95_abs", "signed", "correlation")


def substitution(results: DataFrame, bar: float = 0.5) -> DataFrame:
    """verdict of a substitute: improvement or regression if the interval lies on one side of zero, substitute if it lies within the bar, else inconclusive."""
    low, high = F.col("low"), F.col("high")
    return results.withColumn("verdict", F.when(high < 0, "improvement").when(low > bar, "regression").when((low >= -bar) & (high <= bar), "substitute").otherwise("inconclusive"))


def equivalent(rows: DataFrame, keys: list[str], day: str, actual: str, a: str, b: str, margin: float = 0.5, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """Per key: n, days, the mean difference of absolute errors of a and b with its interval over days, and whether that lies inside the margin on both sides."""
    out = compare(rows, keys, day, actual, a, b, 0, draws, seed).drop("decision")
    return out.withColumn("equivalent", (F.col("low") > -margin) & (F.col("high") < margin))
