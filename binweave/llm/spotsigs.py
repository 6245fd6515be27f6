"""SpotSigs document fingerprints with DataFrame operations only.

A signature is a common-word anchor with the chain of the two content words that
follow it (other common words are skipped). A document's fingerprint is the set
of its distinct signatures, hashed to 32 bits. A text without an anchor gets the
chains of all its content words; a text without words has the empty set.

Two fingerprints can only be alike if their lengths lie in the same or in neighbouring
partitions (each a factor 1 / ALIKE wider) and if they share one of the signatures that
stand first in a common order; what these bounds leave is compared exactly.

Defined results: null texts are empty; two empty fingerprints are alike (1.0), an
empty and a non-empty one are not (0.0); equal texts have equal fingerprints;
other columns are ignored, whatever their names. Neighbours follow ascending ids (any
long), nulls first, of equal ids by text; repeated rows each stand; an empty table
gives no rows; very long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole

# Anchors and further common words of the supported languages.
ANCHORS = ["the", "of", "and", "a", "le", "la", "les", "et", "de", "der", "die", "und", "das", "el", "los", "que", "y"]
COMMON = [
    "to", "in", "is", "that", "it", "was", "for", "on", "with", "as", "be", "at", "by", "this", "are", "from", "an", "or",
    "des", "du", "un", "une", "en", "qui", "dans", "par", "sur", "pour", "au", "est",
    "den", "dem", "von", "zu", "mit", "ist", "im", "ein", "eine", "nicht", "sich", "auf", "des", "als", "auch",
    "las", "del", "se", "con", "por", "una", "su", "es", "para", "no", "lo",
]
WORD = r"\p{L}\p{N}"
MARK = "\u0001"
#: Documents in one range of neighbouring ids, and the most ranges.
RANGE_DOCS, MOST_RANGES = 1024, 65536
#: Fingerprints this much alike count as the same document.
ALIKE = 0.75


def signatures(text: Column) -> Column:
    """The sorted distinct signature hashes of a text, array<bigint>."""
    words = F.split(F.lower(text), rf"[^{WORD}]+")
    # common words go, anchors keep a mark and stay before the content word that follows, which ends with a space
    glued = F.transform(words, lambda x: F.when(x.isin("", *COMMON), "").when(x.isin(*ANCHORS), F.concat(x, F.lit(MARK))).otherwise(F.concat(x, F.lit(" "))))
    return _chains(F.filter(F.split(F.array_join(glued, ""), " "), lambda w: F.length(w) > 0))


def _hashed(own: Column, then: Column) -> Column:
    """The first 32 bits of the MD5 of a signature."""
    return F.conv(F.substring(F.md5(F.concat(own, F.lit(" "), then)), 1, 8), 16, 10).cast("long")


def _chains(words: Column) -> Column:
    """words: content words, those after anchors with the anchors, each with MARK, before them."""

    def chained(w: Column) -> Column:
        then = F.concat(F.transform(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda x: F.substring_index(x, MARK, -1)), F.array(F.lit("")))
        anchored = F.array_compact(F.zip_with(w, then, lambda a, b: F.when(F.instr(a, MARK) > 0, _hashed(a, b))))
        every = F.zip_with(w, then, _hashed)
        return F.sort_array(F.array_distinct(F.when(F.exists(w, lambda x: F.instr(x, MARK) > 0), anchored).otherwise(every)))

    # an array of one array, so that the words are computed once though used several times
    return F.transform(F.array(words), chained)[0]


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets, from their sizes and their intersection."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, F.lit(1.0)).otherwise(both / total)


def _part(n: Column, threshold: float) -> Column:
    """The partition of sets of n signatures; the empty set has one of its own."""
    return F.when(n == 0, -9).otherwise(F.floor(F.log(n.cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int"))


def alike(a: Column, b: Column, threshold: float = ALIKE) -> Column:
    """Whether two sorted signature sets are alike: by partition and length, then by their first signatures, then exactly."""
    na, nb = F.size(a), F.size(b)
    apart = (F.abs(_part(na, threshold) - _part(nb, threshold)) > 1) | (F.least(na, nb) < F.greatest(na, nb) * threshold)
    first = lambda x, n: F.slice(x, 1, F.greatest(n - F.ceil(n * threshold).cast("int") + 1, F.lit(0)))
    return F.when(apart, False).when((na > 0) & ~F.arrays_overlap(first(a, na), first(b, nb)), False).otherwise(likeness(a, b) >= threshold)


def as_text(sigs: Column) -> Column:
    return F.array_join(sigs.cast("array<string>"), ",")


def _range_of(docs: DataFrame, id_col: str) -> Column:
    """The range of each id: Spark's own range partitioning of the ids alone gives the bounds, MOST_RANGES at most; nulls are range 0."""
    n = docs.count()
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_DOCS)))
    ids = docs.select(F.col(id_col).cast("long").alias("id")).filter("id is not null")
    firsts = ids.repartitionByRange(ranges, "id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("id")).collect()
    bounds = sorted({r.id for r in firsts})
    if not bounds:
        return F.lit(0)
    # two steps of about the square root of the bounds each
    step = max(1, int(len(bounds) ** 0.5))
    numbers = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>")
    upto = lambda x: F.size(F.filter(x, lambda b: b <= F.col(id_col)))
    block = F.greatest(upto(numbers(bounds[::step])) - 1, F.lit(0)) * step
    return F.when(F.col(id_col).isNull(), 0).otherwise(block + upto(F.slice(numbers(bounds), block + 1, step)))


def with_next(docs: DataFrame, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """Every row with next_<column> of the row of the next larger id; the last is followed by the first.

    Rows are dealt into ranges of neighbouring ids. The first row of each range also
    visits the range before it, so that one window per range suffices.
    """
    ranged = docs.withColumn("_range", _range_of(docs, id_col))
    # one row per range: MOST_RANGES + 1 at most
    firsts = ranged.groupBy("_range").agg(F.min(id_col).alias("_first"))
    order = Window.orderBy("_range")
    last = F.max("_range").over(Window.partitionBy(F.lit(1)))
    visits = firsts.select("_first", F.coalesce(F.lag("_range").over(order), last).alias("_visits"), F.col("_range").alias("_home"))
    own = ranged.join(F.broadcast(visits), ranged["_range"].eqNullSafe(visits["_home"]) & ranged[id_col].eqNullSafe(visits["_first"]), "left").drop("_first", "_home")
    here = F.array(F.struct(F.col("_range").alias("at"), F.lit(False).alias("guest")))
    there = F.array(F.struct(F.col("_visits").alias("at"), F.lit(True).alias("guest")))
    dealt = own.withColumn("_in", F.explode(F.when(F.col("_visits").isNull(), here).otherwise(F.concat(here, there)))).withColumn("_at", F.col("_in.at")).withColumn("_guest", F.col("_in.guest"))
    w = Window.partitionBy("_at").orderBy("_guest", F.col(id_col).asc_nulls_first(), *columns[:1])
    return dealt.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns)).filter(~F.col("_guest")).drop("_range", "_visits", "_in", "_at", "_guest")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter is the start of the next text."""
    base = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).withColumn("sigs", signatures(F.col("text")))
    near = with_next(base, ["text", "sigs"])
    n = F.length("text")
    edited = F.concat(F.expr("left(text, length(text) - length(text) div 4)"), F.expr("left(next_text, length(text) div 4)"))
    out = near.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sigs", "next_sigs")
    out = out.withColumn("edited_sigs", signatures(F.col("edited")))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("sigs")).alias("fingerprint"), as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        alike(F.col("sigs"), F.col("edited_sigs")).alias("edited_alike"), alike(F.col("sigs"), F.col("next_sigs")).alias("next_alike"),
    )


def similar_pairs(docs: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of distinct fingerprints with Jaccard of at least threshold: (a, b, similarity), named by the smallest id that has each.

    Sets are partitioned by length, each partition a factor 1/threshold wider, so that only equal and
    adjacent partitions can hold a pair. Within them a pair must share one of the first
    n - ceil(threshold * n) + 1 signatures in ascending order of frequency; lengths prune before the exact comparison.
    """
    sets = docs.select(F.col(id_col).alias("id"), signatures(whole(text_col)).alias("sigs")).groupBy("sigs").agg(F.min("id").alias("id")).filter(F.size("sigs") > 0)
    n = F.size("sigs")
    sets = sets.withColumn("n", n).withColumn("part", _part(n, threshold))
    each = sets.select("id", "n", "part", F.explode("sigs").alias("sig"))
    counts = each.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = each.join(counts, "sig").filter("df > 1").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("df", "sig")) + (F.col("n") - F.count("*").over(Window.partitionBy("id"))))
    prefix = ranked.filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).select("id", "n", "part", "sig")
    small, large = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), F.explode(F.array("part", F.col("part") + 1)).alias("part"), "sig"), prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "part", "sig")
    pairs = small.join(large, ["part", "sig"]).filter("na < nb or (na = nb and a < b)").filter(F.col("na") >= F.col("nb") * threshold).select("a", "b").distinct()
    full = sets.select("id", "sigs")
    checked = pairs.join(full.withColumnsRenamed({"id": "a", "sigs": "sa"}), "a").join(full.withColumnsRenamed({"id": "b", "sigs": "sb"}), "b")
    return checked.withColumn("similarity", likeness(F.col("sa"), F.col("sb"))).filter(F.col("similarity") >= threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
