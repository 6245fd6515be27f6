"""Language identification of whole, possibly mixed-language texts.

A word's script (Unicode ranges) leaves the languages that were seen in it. Each
word gets a log-likelihood per language, from its letter trigrams and the word
itself (hashed counts). Viterbi over the words, with a penalty for switching
language, labels spans; a document's language is the one with most letters.

Learning: every task sums hashed counts over its rows, Spark adds them up, and the
driver holds one table of BUCKETS counts per language, whatever the input.

A letter is a character of a Unicode letter category; combining marks belong to the word
they follow, and a run of marks alone (as after emoji) is no word.

Defined results: null texts and texts without a letter are `und` with score 0;
rows with a null language are not learned from; ties go to the language that sorts
first; with nothing learned all is `und`; repeated rows, and rows with null or
repeated ids, are labelled each; an empty table gives no rows; very long texts are
labelled whole, a text alone at a time if need be; other columns are ignored. Any
number of languages may be learned.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, narrow_batches

#: Hashed counts per language: letter trigrams in the first half, words in the second.
BUCKETS = 1 << 17
HALF = BUCKETS // 2
#: A language is a candidate in a script if this share of its words was seen in it.
SCRIPT_SHARE = 0.005
SWITCH = 8.0
UNKNOWN = "und"
# First and last code points of scripts.
SCRIPTS = [
    (0x41, 0x24F), (0x370, 0x3FF), (0x400, 0x52F), (0x530, 0x58F), (0x590, 0x5FF), (0x600, 0x77F), (0x900, 0x97F), (0x980, 0x9FF), (0xE00, 0xE7F),
    (0x10A0, 0x10FF), (0x1100, 0x11FF), (0x1E00, 0x1EFF), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF),
]
SPANS = "array<struct<start:int,end:int,lang:string>>"
#: Characters handled at once.
_AT_ONCE = 1 << 20


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 2 for letters, 1 for marks; lower-case form; script (0: other)."""
    top = 0x40000  # the planes beyond hold no letters
    inside = np.fromiter(("ML".find(unicodedata.category(chr(i))[0]) + 1 for i in range(top)), np.int8, top)
    lower = np.fromiter((ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(top)), np.uint32, top)
    script = np.zeros(top, np.int8)
    for k, (a, b) in enumerate(SCRIPTS, 1):
        script[a : b + 1] = k
    script[0x1E00:0x1F00] = 1
    return inside, lower, script


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """The words of several texts: each one's text, span there, script; and its hashed trigrams, joined, with where each word's begin."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    script: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    word: np.ndarray


def words_of(texts: list[str | None]) -> Words:
    inside, lower, script = _tables()
    joined = [(t or "") + "\n" for t in texts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in joined])])
    codes = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < len(lower), codes, 0)
    kind = inside[codes]
    letter = kind > 0
    edge = np.diff(np.concatenate([[0], letter.view(np.int8), [0]]))
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(begin):
        bare = np.maximum.reduceat(kind, begin) < 2  # runs of marks alone
        for a, b in zip(begin[bare], stop[bare], strict=True):
            letter[a:b] = False
        begin, stop = begin[~bare], stop[~bare]
    c = np.where(letter, lower[codes], 0).astype(np.uint64)
    where = np.flatnonzero(letter)
    if not len(where):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none, none, none, none)
    before = np.concatenate([[np.uint64(0)], c[:-1]])
    after = np.concatenate([c[1:], [np.uint64(0)]])
    mid = c[where]
    grams = (_mix((before[where] << np.uint64(42)) | (mid << np.uint64(21)) | after[where]) % np.uint64(HALF)).astype(np.int64)
    length = stop - begin
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    nth = (np.arange(len(where)) - np.repeat(first, length)).astype(np.uint64)
    word = (_mix(np.add.reduceat(_mix(mid + (nth << np.uint64(21))), first)) % np.uint64(HALF)).astype(np.int64) + HALF
    text = np.searchsorted(at, begin, "right") - 1
    return Words(text, begin - at[text], length, script[codes[begin]].astype(np.int64), grams, first, word)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about _AT_ONCE characters together."""
    a = size = 0
    for b, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= _AT_ONCE:
            yield a, b + 1
            a, size = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


@dataclass
class Model:
    langs: list[str]
    logs: np.ndarray  # BUCKETS x languages
    allowed: np.ndarray  # scripts x languages

    def likelihoods(self, w: Words) -> np.ndarray:
        s = np.add.reduceat(self.logs[w.grams], w.first, axis=0) + self.logs[w.word]
        return s - 1000.0 * ~self.allowed[w.script]


def learn(docs: DataFrame) -> Model:
    """docs(text, lang) -> the model of all their rows."""
    narrow_batches(docs.sparkSession)
    scripts = len(SCRIPTS) + 1

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, own in b.groupby("lang")["text"]:
                texts = own.to_list()
                total = sums.setdefault(lang, np.zeros(BUCKETS + scripts, np.int64))
                for i, j in _chunks(texts):
                    w = words_of(texts[i:j])
                    for x in (w.grams, w.word, w.script + BUCKETS):
                        total += np.bincount(x, minlength=BUCKETS + scripts)
        for lang, total in sums.items():
            k = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": k, "n": total[k]})

    counts = docs.filter("lang is not null and text is not null").select("lang", "text").mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    logs, allowed = np.zeros((BUCKETS, len(langs)), np.float32), np.zeros((scripts, len(langs)), bool)
    for k, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        n = np.zeros(BUCKETS + scripts)
        n[own["bucket"].to_numpy()] = own["n"].to_numpy()
        for part in (slice(0, HALF), slice(HALF, BUCKETS)):
            logs[part, k] = np.log((n[part] + 0.1) / (n[part].sum() + 0.1 * HALF))
        allowed[:, k] = n[BUCKETS:] >= SCRIPT_SHARE * max(1, n[BUCKETS:].sum())
    allowed[~allowed.any(axis=1)] = True
    return Model(langs, logs, allowed)


def viterbi(scores: np.ndarray, first: np.ndarray, count: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word. scores: words x labels of all texts in turn; text i has count[i] words from first[i] on."""
    kind = np.min_scalar_type(-max(1, scores.shape[1]))
    labels = np.zeros(len(scores), kind)
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 0]
    a = 0
    while a < len(order):
        # texts side by side, the longer the fewer
        texts = order[a : a + min(128, max(1, _AT_ONCE // int(count[order[a]])))]
        a += len(texts)
        n, most = count[texts], int(count[texts[0]])
        at = first[texts]
        alive = np.searchsorted(-n, -np.arange(1, most + 1), "right")  # texts that have a t-th word; they stand first
        v = scores[at].astype(np.float64)
        came = np.zeros((most, len(texts), scores.shape[1]), kind)
        keep = np.arange(scores.shape[1], dtype=kind)
        for t in range(1, most):
            m = alive[t]
            own = v[:m]
            best = own.argmax(axis=1)
            jump = own[np.arange(m), best] - switch
            stay = own >= jump[:, None]
            came[t, :m] = np.where(stay, keep, best[:, None])
            v[:m] = np.where(stay, own, jump[:, None]) + scores[at[:m] + t]
        now = v.argmax(axis=1).astype(kind)
        for t in range(most - 1, -1, -1):
            m = alive[t]
            labels[at[:m] + t] = now[:m]
            if t:
                now[:m] = came[t, np.arange(m), now[:m]]
    return labels


def _label(texts: list[str | None], model: Model, switch: float, spans: bool) -> list[tuple]:
    out: list[tuple] = []
    for i, j in _chunks(texts):
        w = words_of(texts[i:j])
        n = j - i
        if not len(w.text) or not model.langs:
            out += [(UNKNOWN, 0.0, [])] * n
            continue
        count = np.bincount(w.text, minlength=n)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        labels = viterbi(model.likelihoods(w), first, count, switch).astype(np.int64)
        size = len(model.langs)
        letters = np.bincount(w.text * size + labels, weights=w.length, minlength=n * size).reshape(n, size)
        top, total = letters.argmax(axis=1), letters.sum(axis=1)
        for k in range(n):
            if not total[k]:
                out.append((UNKNOWN, 0.0, []))
                continue
            found = []
            if spans:
                a, b = first[k], first[k] + count[k]
                cut = np.concatenate([[a], a + 1 + np.flatnonzero(np.diff(labels[a:b])), [b]])
                found = [{"start": int(w.start[x]), "end": int(w.start[y - 1] + w.length[y - 1]), "lang": model.langs[labels[x]]} for x, y in zip(cut[:-1], cut[1:], strict=True)]
            out.append((model.langs[top[k]], float(letters[k, top[k]] / total[k]), found))
    return out


def label_documents(docs: DataFrame, model: Model, switch: float = SWITCH, spans: bool = True) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (its share of the letters) and the labelled spans, in characters."""
    narrow_batches(docs.sparkSession)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = _label(b["text"].to_list(), model, switch, spans)
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "spans": [r[2] for r in rows]})

    # ids travel as strings, as pandas would round long ids where some are null
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(label, f"doc_id string, lang_pred string, score double, spans {SPANS}").withColumn("doc_id", F.col("doc_id").cast("long"))


def identify_documents(docs: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out, and label every document."""
    model = learn(docs.filter(~held_out()))
    return label_documents(docs, model, spans=False).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
