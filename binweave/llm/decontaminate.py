"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words are counted over all documents (one pass,
   summed by each task, added up by Spark).
2. The benchmark's items are cut into passages of ITEM_WORDS words. A randomised SVD
   of their TF-IDF matrix, with the corpus' frequencies, gives a latent space: two
   distributed passes over the passages, of which the driver sees sums of RANK columns.
3. All documents are cut into overlapping passages and folded into that space; one
   whose cosine with an item's passage is at least COSINE is a candidate. The most that
   any item's passage has of each word bounds the cosine, so most are dismissed without
   the product; none is dismissed that could reach the threshold.
4. A candidate is a leak if the longest common subsequence of the item and a stretch of
   the document hardly longer holds at least COMMON of the item's words, and at least
   ANSWER of its last quarter, where the answer stands.

The items are dealt by hash into blocks of about RANK passages, each with its own space
of as many dimensions as the block has passages: every passage lies in it whole, so the
cosines are those of the TF-IDF vectors. GROUP blocks at most are sent to tasks at once;
more take further passes over the documents, so that what tasks receive is bounded.

Words of many documents have no weight, and a copied item may itself make its words
frequent. An item of which even an exact copy might stay below COSINE, in windows filled
up with the rarest words, goes to blocks of its own, which are also searched with equal
weights of all words; each passage's threshold is then at most the least cosine of a
window that holds COMMON of it.

Defined results: null and empty texts hold no leak; items without a word match
nothing; repeated items are reported under each id; repeated rows are reported each, under null
or equal ids too; of several places the one with the longest common subsequence counts,
of equal ones that of the larger cosine, then the later; empty tables give no rows; very
long texts are searched whole; other columns are ignored, whatever their names (drop_leaks
returns them as they are).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, lean, narrow_batches
from .jaccard import mix

HASHES = 1 << 16
ITEM_WORDS, STEP, SPAN = 32, 12, 4  # words of an item's passage; words of a step, most steps of a document's passage
RANK, GROUP, COSINE = 256, 16, 0.3  # passages of a block on average; blocks sent at once
#: Bytes of text, and steps or windows, looked at together.
BATCH, AT_ONCE = 1 << 18, 2048
#: Words in more than this share of the documents (and FREQUENT documents) have no weight.
SHARE, FREQUENT = 0.1, 20
COMMON, ANSWER = 0.7, 0.5
# Typographic marks that part words.
MARKS = "“”„‘’‚«»…–—·¡¿"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_INSIDE = np.zeros(256, bool)
_INSIDE[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True
LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("common", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())]))


def lowered(text: str | None) -> bytes:
    text = (text or "").lower()
    if not text.isascii():
        for c in MARKS:
            text = text.replace(c, " ")
    return text.encode("utf-8", "surrogatepass")


def hashed(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash bucket of every word of the texts in turn, and how many words each text has."""
    data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    inside = _INSIDE[data]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8)]))
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.searchsorted(begin, np.cumsum([len(x) + 1 for x in raws]))
    count = np.diff(np.concatenate([[0], ends]))
    if not len(begin):
        return np.zeros(0, np.int64), count
    length = stop - begin
    where = np.flatnonzero(inside)
    first = np.cumsum(length) - length
    nth = np.arange(len(where)) - np.repeat(first, length)
    chars = mix((nth.astype(np.uint64) << np.uint64(8)) + data[where] + np.uint64(1))
    return (mix(np.add.reduceat(chars, first)) % np.uint64(HASHES)).astype(np.int64), count


def _batches(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    i = 0
    while i < len(texts):
        own, size, at = [], 0, i
        while i < len(texts) and size < BATCH:
            own.append(lowered(texts[i]))
            size += len(own[-1])
            i += 1
        yield at, own


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each hash occurs, and how many documents there are."""
    narrow_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean()
        total = np.zeros(HASHES + 1, np.int64)
        for b in batches:
            total[HASHES] += len(b)
            for _, raws in _batches(b["text"].to_list()):
                words, n = hashed(raws)
                key = np.unique(np.repeat(np.arange(len(n)), n) * HASHES + words)
                total[:HASHES] += np.bincount(key % HASHES, minlength=HASHES)
        k = np.flatnonzero(total)
        yield pd.DataFrame({"hash": k, "n": total[k]})

    rows = docs.select("text").mapInPandas(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(HASHES + 1, np.int64)
    out[rows["hash"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out[:HASHES], int(out[HASHES])


def weights(n: np.ndarray, total: int) -> np.ndarray:
    """Inverse document frequencies; none for frequent words. Items that lose by that are found by `weak`."""
    return np.where(n > SHARE * total + FREQUENT, 0, np.log((total + 1) / (n + 0.5)).clip(0.01)).astype(np.float32)


def _chunks(words: np.ndarray) -> list[np.ndarray]:
    """An item's passages: all of it, or ITEM_WORDS words at every half of that, the last ones included."""
    if len(words) <= ITEM_WORDS:
        return [words] if len(words) else []
    starts = [*range(0, len(words) - ITEM_WORDS, ITEM_WORDS // 2), len(words) - ITEM_WORDS]
    return [words[s : s + ITEM_WORDS] for s in starts]


def _span(words: int) -> int:
    """The steps of the windows in which a passage is sought: a window of s steps holds every stretch of up to s * STEP - (STEP - 1) words."""
    return SPAN - 1 if words <= (SPAN - 1) * STEP - STEP + 1 else SPAN


def weak(words: np.ndarray, idf: np.ndarray, total: int) -> bool:
    """Whether no passage of the item is sure to reach COSINE where it stands unchanged, whatever surrounds it."""
    rarest = max(0.01, float(np.log((total + 1) / 1.5)))
    for c in _chunks(words):
        own = float(((np.unique(c, return_counts=True)[1] * idf[np.unique(c)]) ** 2).sum())
        if own > 0 and own >= 1.01 * COSINE**2 * (own + (_span(len(c)) * STEP - len(c)) * rarest**2):
            return False
    return True


def _least_cosine(passage: np.ndarray) -> float:
    """With equal weights: the least cosine of a passage and a window that holds COMMON of its words."""
    _, inverse, count = np.unique(passage, return_inverse=True, return_counts=True)
    times = np.sort(count[inverse])
    return 0.999 * float(times[: max(1, int(np.ceil(COMMON * len(times) - 1e-9)))].sum() / np.sqrt((count**2).sum() * _span(len(passage)) * STEP))


def _matrix(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item number, steps of the windows it is sought in, hashes in use, unit TF-IDF row over those) of the items' passages; a block of items at most."""
    words, n = hashed([lowered(t) for t in texts])
    used = np.unique(words)
    parts, items = [], []
    for k, own in enumerate(np.split(np.searchsorted(used, words), np.cumsum(n)[:-1])):
        for c in _chunks(own):
            parts.append(c)
            items.append(k)
    rows = np.zeros((len(parts), len(used)), np.float32)
    for r, c in zip(rows, parts, strict=True):
        np.add.at(r, c, 1)
        r *= idf[used]
        r /= max(1e-9, float(np.sqrt((r**2).sum())))
    return np.array(items, np.int64), np.array([_span(len(c)) for c in parts], np.int64), used, rows


def _summed(df: DataFrame, width: int) -> dict[int, np.ndarray]:
    rows = df.groupBy("k").agg(F.array(*(F.sum(F.col("x")[i]) for i in range(width))).alias("x")).collect()
    return {r.k: np.array(r.x) for r in rows}


def latent_space(items: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Randomised SVD of the items' TF-IDF passages A: hashes in use, and their rows of the right singular vectors (hashes x rank).

    One pass sums A'A W for a Gaussian W (drawn by each task, a hash's row from its own seed),
    another the small matrix of A in the basis found, whose eigenvectors turn it.
    """

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            _, _, k, a = _matrix(b["text"].to_list(), idf)
            w = np.stack([np.random.default_rng((seed, int(h))).standard_normal(rank, dtype=np.float32) for h in k]) if len(k) else np.zeros((0, rank), np.float32)
            live = a.any(axis=0)
            z = a[:, live].T @ (a[:, live] @ w[live])
            yield pd.DataFrame({"k": k[live], "x": pd.Series(list(z.astype(float)), dtype=object)})

    found = _summed(items.mapInPandas(sketch, "k long, x array<double>"), rank)
    if not found:
        return np.zeros(0, np.int64), np.zeros((0, 0), np.float32)
    keys = np.array(sorted(found))
    q, r = np.linalg.qr(np.array([found[k] for k in keys]))
    q = q[:, np.abs(np.diag(r)) > 1e-6 * np.abs(np.diag(r)).max()].astype(np.float32)

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            _, _, k, a = _matrix(b["text"].to_list(), idf)
            there = np.isin(k, keys)
            y = a[:, there] @ q[np.searchsorted(keys, k[there])]
            yield pd.DataFrame({"k": range(q.shape[1]), "x": pd.Series(list((y.T @ y).astype(float)), dtype=object)})

    g = _summed(items.mapInPandas(gram, "k long, x array<double>"), q.shape[1])
    values, turn = np.linalg.eigh(np.array([g[k] for k in range(q.shape[1])]))
    keep = values > 1e-6 * values.max()
    return keys, (q @ turn[:, keep]).astype(np.float32)


def common_words(a: list, b: list) -> int:
    """The length of the longest common subsequence, by bit-parallel rows."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def stretch_length(n: int) -> int:
    """Words of a stretch that may hold an item of n words."""
    return n + n // 4 + 2


def matched(item: list[bytes], words: list[bytes], least: float = COMMON, answer: float = ANSWER) -> tuple[float, int, int] | None:
    """The share of the item's words in the best stretch of the words, and that stretch, if it makes a leak."""
    n = len(item)
    size = stretch_length(n)
    best, at = 0, 0
    for s in range(0, max(1, len(words) - n // 2), max(1, n // 8)):
        if (c := common_words(item, words[s : s + size])) > best:
            best, at = c, s
    tail = item[-max(1, n // 4) :]
    if best < least * n or common_words(tail, words[at : at + size]) < answer * len(tail):
        return None
    return best / n, at, min(len(words), at + size)


@dataclass
class Index:
    """What tasks need of one block of items: for hashes in use the row of their latent vector (times the weight), weights, passages and words."""

    row: np.ndarray
    vectors: np.ndarray
    idf: np.ndarray
    passages: np.ndarray
    items: np.ndarray
    span: np.ndarray
    ids: list[int]
    words: list[list[bytes]]
    #: The cosine from which each passage is a candidate.
    least: np.ndarray
    #: Place of each hash among the items' words, and which places each item has (the last one: no word of theirs).
    slot: np.ndarray
    holds: np.ndarray
    #: By steps of a window: of each hash its weight times the most that a passage sought there has of it.
    peaks: dict[int, np.ndarray]
    #: The same items with equal weights, for candidates beside these.
    flat: Index | None = None

    def candidates(self, words: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(text, first word, item, cosine) of passages near an item. Short passages of items are sought in windows a step shorter."""
        steps = -(-n // STEP)
        at = np.cumsum(n) - n
        text = np.repeat(np.arange(len(n)), steps)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(steps) - steps, steps)
        begin = at[text] + nth * STEP
        if not len(begin) or not len(self.vectors):
            return
        weight = self.idf[words]
        row = self.row[words]
        used = (row >= 0) & (weight > 0)
        size, part = np.add.reduceat(weight**2, begin), np.add.reduceat(used.astype(np.int32), begin)
        padded_text = np.concatenate([text, np.full(SPAN, -1)])
        near = [padded_text[j : j + len(text)] == text for j in range(SPAN)]
        over = lambda x, span: sum(np.concatenate([x, np.zeros(SPAN)])[j : j + len(text)] * near[j] for j in range(span))
        chosen: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        needed = np.zeros(len(begin) + SPAN, bool)
        for span in (SPAN - 1, SPAN):
            kind = np.flatnonzero(self.span == span)
            if not len(kind):
                continue
            # no passage has more of a word than the largest of them; repeated words only make `whole` smaller, and so the bound larger
            whole = over(size, span)
            own = np.flatnonzero(over(np.add.reduceat(self.peaks[span][words], begin), span) >= self.least[kind].min() * np.sqrt(whole) * 0.99)
            own = own[whole[own] > 0]
            chosen.append((span, kind, own, whole))
            for j in range(span):
                needed[own[near[j][own]] + j] = True
        # the needed steps' vectors: the first words in use of all steps at once, then the second, ...
        live = np.flatnonzero(needed[: len(begin)] & (part > 0))
        if not len(live):
            return
        place = np.full(len(begin) + SPAN, len(live))
        place[live] = np.arange(len(live))
        own = place[np.repeat(np.arange(len(begin)), np.diff(np.concatenate([begin, [len(words)]])))]
        where = np.flatnonzero(used & (own < len(live)))
        own = own[where]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        rank = np.arange(len(where)) - np.repeat(first, np.diff(np.concatenate([first, [len(where)]])))
        sums = np.zeros((len(live) + 1, self.vectors.shape[1]), np.float32)
        for k in range(int(rank.max()) + 1):
            now = np.flatnonzero(rank == k)
            for j in range(0, len(now), AT_ONCE):
                part_ = now[j : j + AT_ONCE]
                sums[own[part_]] += self.vectors[row[where[part_]]]
        for span, kind, windows, whole in chosen:
            least = self.least[kind]
            for k in range(0, len(windows), AT_ONCE):
                own = windows[k : k + AT_ONCE]
                x = sums[place[own]]
                for j in range(1, span):
                    x += sums[np.where(near[j][own], place[own + j], len(live))]
                c = x @ self.passages[kind].T / np.sqrt(whole[own])[:, None]
                i, q = np.nonzero(c >= least)
                yield from zip(text[own[i]].tolist(), (nth[own[i]] * STEP).tolist(), self.items[kind[q]].tolist(), c[i, q].clip(max=1.0).tolist(), strict=True)

    def leaks(self, raws: list[bytes], words: np.ndarray, n: np.ndarray, split: dict[int, list[bytes]]) -> Iterator[tuple[int, tuple]]:
        """(text, leak) of the texts, of which `split` keeps the words."""
        near: dict[tuple[int, int], list[tuple[float, int]]] = {}
        for t, at, item, c in chain(self.candidates(words, n), self.flat.candidates(words, n) if self.flat else ()):
            near.setdefault((t, item), []).append((c, at))
        slots, begin = self.slot[words], (np.cumsum(n) - n).tolist()
        for (t, item), places in sorted(near.items()):
            size = len(self.words[item])
            # no subsequence is longer than the words of its stretch that the item has
            a, b = max(0, min(at for _, at in places) - size), min(int(n[t]), max(at for _, at in places) + STEP * SPAN + size)
            upto = np.concatenate([[0], np.cumsum(self.holds[item][slots[begin[t] + a : begin[t] + b]])])
            most = min(stretch_length(size), b - a)
            if (upto[most:] - upto[: len(upto) - most]).max() < COMMON * size:
                continue
            if t not in split:
                split[t] = _WORD.findall(raws[t])
            own = split[t]
            found = None
            for c, at in sorted(places, reverse=True):
                low = max(0, at - size)
                stretch = own[low : at + STEP * SPAN + size]
                there = set(stretch)
                # no subsequence holds more of the item's words than stand there at all
                if sum(w in there for w in self.words[item]) < COMMON * size:
                    continue
                if m := matched(self.words[item], stretch):
                    if found is None or m[0] > found[2]:
                        found = (self.ids[item], max(x for x, _ in places), m[0], low + m[1], low + m[2])
                    if m[0] == 1:
                        break
            if found:
                yield t, found


def leaks_in(texts: list[str | None], indexes: list[Index]) -> list[list[tuple]]:
    out: list[list[tuple]] = [[] for _ in texts]
    for first, raws in _batches(texts):
        words, n = hashed(raws)
        split: dict[int, list[bytes]] = {}
        for index in indexes:
            for t, found in index.leaks(raws, words, n, split):
                out[first + t].append(found)
    return out


def _dealt_items(benchmark: DataFrame, idf: np.ndarray, total: int) -> DataFrame:
    """The items that have words, with `kind` (1: weak) and the number of their block within it."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for item, text in zip(b["item_id"].tolist(), b["text"].to_list(), strict=True):
                words, _ = hashed([lowered(text)])
                if len(words):
                    rows.append((item, text, len(_chunks(words)), int(weak(words, idf, total))))
            yield pd.DataFrame(rows, columns=["item_id", "text", "passages", "kind"])

    rows = benchmark.filter("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    items = durable(rows.mapInPandas(counted, "item_id string, text string, passages long, kind int").withColumn("item_id", F.col("item_id").cast("long")), "benchmark")
    blocks = {r.kind: max(1, round(r.n / RANK)) for r in items.groupBy("kind").agg(F.sum("passages").alias("n")).collect()}
    number = F.pmod(F.xxhash64("item_id", "text"), F.when(F.col("kind") == 1, blocks.get(1, 1)).otherwise(blocks.get(0, 1)))
    return items.withColumn("block", number)


def build_indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator[list[Index]]:
    """The indexes of the benchmark's blocks, GROUP at a time, with the word frequencies of all documents."""
    n, total = document_frequencies(docs)
    idf, flat = weights(n, total), np.ones(HASHES, np.float32)
    items = durable(_dealt_items(benchmark, idf, total), "benchmark-blocks")
    group = []
    for b in items.groupBy("kind", "block").agg(F.sum("passages").alias("n")).orderBy("kind", "block").collect():
        own = items.filter((F.col("kind") == b.kind) & (F.col("block") == b.block)).select("item_id", "text")
        index = _index(own, idf, int(b.n))
        index.flat = _index(own, flat, int(b.n), True) if b.kind else None
        group.append(index)
        if len(group) == GROUP:
            yield group
            group = []
    if group:
        yield group


def _index(own: DataFrame, idf: np.ndarray, passages: int, flat: bool = False) -> Index:
    keys, space = latent_space(own, idf, passages)
    items = own.orderBy("item_id", "text").collect()  # about RANK passages
    texts = [r.text for r in items]
    number, span, hashes, a = _matrix(texts, idf)
    row = np.full(HASHES, -1, np.int32)
    row[keys] = np.arange(len(keys))
    there = row[hashes] >= 0
    latent = a[:, there] @ space[row[hashes[there]]]
    # of unit length again, whatever the rounding of the space took
    latent /= np.maximum(1e-9, np.sqrt((latent**2).sum(axis=1, keepdims=True)))
    words, n = hashed([lowered(t) for t in texts])
    chunks = [c for w in np.split(words, np.cumsum(n)[:-1]) for c in _chunks(w)]
    least = np.array([min(COSINE, _least_cosine(c)) if flat else COSINE for c in chunks])
    peaks = {}
    for k in np.unique(span).tolist():
        peaks[k] = np.zeros(HASHES, np.float32)
        peaks[k][hashes] = a[span == k].max(axis=0) * idf[hashes]
    each = np.unique(words)
    slot = np.full(HASHES, len(each), np.int32)
    slot[each] = np.arange(len(each))
    holds = np.zeros((len(items), len(each) + 1), bool)
    holds[np.repeat(np.arange(len(items)), n), slot[words]] = True
    return Index(row, space * idf[keys, None], idf, latent, number, span, [r.item_id for r in items], [_WORD.findall(lowered(t)) for t in texts], least, slot, holds, peaks)


def leaks_of(text: Column, indexes: list[Index]) -> Column:
    @F.pandas_udf(LEAKS)
    def find(texts: pd.Series) -> pd.Series:
        lean()
        names = LEAKS.elementType.names
        return pd.Series([[dict(zip(names, t, strict=True)) for t in found] for found in leaks_in(texts.to_list(), indexes)], index=texts.index, dtype=object)

    return find(text)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, cosine, common, first_word, last_word."""
    groups = build_indexes(docs, benchmark)
    narrow_batches(docs.sparkSession)
    found = lambda indexes: docs.select("doc_id", F.explode(leaks_of(F.col("text"), indexes)).alias("x")).select("doc_id", "x.*")
    first, second = next(groups, []), next(groups, None)
    if second is None:
        return found(first)
    # a pass for each group; what it found is written once, the corpus never
    out = durable(found(first), "leaks").unionAll(durable(found(second), "leaks"))
    del first, second
    for indexes in groups:
        out = out.unionAll(durable(found(indexes), "leaks"))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all columns."""
    groups = build_indexes(docs, benchmark)
    narrow_batches(docs.sparkSession)
    first, second = next(groups, []), next(groups, None)
    if second is None:
        return docs.filter(F.size(leaks_of(F.col("text"), first)) <= 0)
    digest = F.sha2(F.col("text"), 256)
    leaky = lambda indexes: durable(docs.filter(F.size(leaks_of(F.col("text"), indexes)) > 0).select(digest.alias("_digest")).distinct(), "leaky")
    marks = leaky(first).unionAll(leaky(second))
    del first, second
    for indexes in groups:
        marks = marks.unionAll(leaky(indexes))
    # texts are judged by what they are, so that equal ones share their fate, whatever their ids
    return docs.withColumn("_digest_of_text", digest).join(marks.distinct(), F.col("_digest_of_text") == F.col("_digest"), "left_anti").drop("_digest_of_text")
