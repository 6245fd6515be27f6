"""Importance resampling of documents towards a target distribution of hashed word n-grams.

Each feature (a run of 1 to `grams` words) falls into one of `buckets` buckets by the
CRC-32 of its UTF-8 bytes. A bucket's gain is the log ratio of its smoothed shares in the
target and in the corpus, in thousandths, rounded down. A document weighs the rounded-down
mean gain of its features; with Gumbel noise from its id added, the highest scores are a
sample drawn without replacement in proportion to exp(weight).

Scoring explodes nothing: higher-order functions make a document's array of buckets and sum
the elements of a literal array of gains. What shuffles are the totals of the buckets, the
counts of equal scores, and of the documents the drawn ones with their ids and numbers.
Ranks come from the counts above a score plus a place among equal scores, so that no task
sorts the whole draw. The driver holds a total for each bucket and a count for each distinct
score: scores are whole thousandths between the least and greatest noise plus gain, some tens
of thousands at most, whatever the input.

Defined results: null and empty texts, and texts without a word, have no features and weigh
0; they are ranked only if `least_words` is 0. Null ids count as the empty string in the
noise. Repeated rows are scored each, and take successive ranks; ties go to the smaller id,
null first. An empty corpus gives no rows, an empty target only smoothing. Very long texts
are counted whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, whole

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII but digits and lower-case letters (upper-case ones are lowered before).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _pieces(text: Column | str) -> Column:
    return F.split(F.translate(whole(text), UPPER, LOWER), BETWEEN)


def words(text: Column | str) -> Column:
    """The words of a whole text, A to Z lowered; none for null."""
    return F.filter(_pieces(text), lambda w: w != "")


def _bucket(w: Column, buckets: int) -> Column:
    return (F.crc32(w.cast("binary")) % buckets).cast("int")


def word_buckets(text: Column | str, buckets: int) -> Column:
    """The bucket of every word of a whole text, in one expression: a long text's words are never a column of their own."""
    return F.array_compact(F.transform(_pieces(text), lambda w: F.when(w != "", _bucket(w, buckets))))


def bucket_array(found: Column, grams: int, buckets: int) -> Column:
    """The bucket of every run of 1 to `grams` of the words, as one array."""
    bucket = lambda w: _bucket(w, buckets)

    def runs(n: int) -> Column:
        starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(found, i, n), " ")))

    return F.concat(F.transform(found, bucket), *map(runs, range(2, grams + 1)))


def _own(texts: DataFrame, grams: int, buckets: int, text_col: str, *keep: Column) -> DataFrame:
    """n_words and own, the array of buckets, of every text, beside the columns kept."""
    if grams == 1:
        return texts.select(*keep, word_buckets(text_col, buckets).alias("own")).withColumn("n_words", F.size("own"))
    # the words are a column first: inside a lambda they would be split anew for every element
    found = texts.select(*keep, words(text_col).alias("words"))
    return found.withColumns({"n_words": F.size("words"), "own": bucket_array(F.col("words"), grams, buckets)}).drop("words")


def bucket_totals(texts: DataFrame, grams: int = 1, buckets: int = 10_000, text_col: str = "text") -> dict[int, int]:
    """Features in each bucket over a whole table; buckets without any are left out."""
    own = _own(texts, grams, buckets, text_col)
    # an outer explode: for a plain one Spark would first filter by the array's size, and work the array out twice
    rows = own.select(F.explode_outer("own").alias("bucket")).filter("bucket is not null").groupBy("bucket").count().collect()
    return {r["bucket"]: r["count"] for r in rows}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = 10_000) -> list[int]:
    """A bucket's log ratio of smoothed shares, target to corpus, in thousandths rounded down."""
    s, t = sum(corpus.values()), sum(target.values())
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * (s + buckets) / ((corpus.get(b, 0) + 1) * (t + buckets)))) for b in range(buckets)]


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, of the id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def scored(docs: DataFrame, gain: list[int], grams: int = 1, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document, without a shuffle."""
    table = F.array(*map(F.lit, gain))
    base = _own(docs, grams, len(gain), text_col, F.col(id_col).alias("doc_id"))
    total = F.aggregate("own", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(table, b + 1))
    n = F.size("own").cast("long")
    # whole numbers throughout: the mean is rounded down without a detour over doubles
    weight = F.when(n > 0, ((total - F.pmod(total, n)) / F.when(n > 0, n).otherwise(1)).cast("long")).otherwise(F.lit(0).cast("long"))
    return base.select("doc_id", "n_words", n.alias("n_features"), weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, grams: int = 1, buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every document with n_features, weight, score, and its rank (1, 2, ...) if it is among the drawn `percent` of those with `least_words`."""
    gain = gains(bucket_totals(docs, grams, buckets, text_col), bucket_totals(target, grams, buckets), buckets)
    base = durable(scored(docs, gain, grams, seed, id_col, text_col), "resampling-scores")
    counts = sorted(((r["score"], r["count"]) for r in base.filter(F.col("n_words") >= least_words).groupBy("score").count().collect()), reverse=True)
    draw, above, before = percent * sum(n for _, n in counts) // 100, 0, []
    for score, n in counts:
        if above >= draw:
            break
        before.append((score, above))
        above += n
    spark = docs.sparkSession
    least = before[-1][0] if before else None
    may = (F.col("n_words") >= least_words) & (F.col("score") >= F.lit(least)) if before else F.lit(False)
    out = ["doc_id", "n_features", "weight", "score"]
    heads = F.broadcast(spark.createDataFrame(before, "score long, above long"))
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first()))
    drawn = base.filter(may).join(heads, "score").select(*out, (F.col("above") + place).alias("rank"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return drawn.unionByName(base.filter(~F.coalesce(may, F.lit(False))).select(*out, F.lit(None).cast("long").alias("rank")))
