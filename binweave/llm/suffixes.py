"""Repeated passages over a whole corpus, by a distributed merge sort of sampled suffixes.

A byte is repeated if some string of `least` bytes that covers it also starts anywhere
else, in this document or another; strings don't cross documents.

Sampling: the anchor of a `least`-byte string is the position in its first WINDOW bytes
whose 8-byte gram has the smallest hash (the first such). Equal strings have equal
anchors, so only anchored suffixes need sorting: about one in WINDOW / 2 bytes. The
strings of one anchor start one after another and form a *run*, with a core, the
least - WINDOW + 1 bytes from the anchor that all of them hold.

1. Cores are exchanged as hashes. An anchor whose core is nowhere else is done; one
   whose whole run is elsewhere too is repeated as a whole.
2. The remaining anchors' suffixes (one for each distinct repeated run, all others) are
   sorted by each task, front-coded against their predecessors, and exchanged by
   ranges of core hashes. A loser tree merges the sorted runs: it knows every head's
   common prefix with the last suffix put out and compares only what lies beyond.
3. Common prefixes of the sorted suffixes, and common suffixes of what stands before
   the anchors, tell for each string of a run whether another one equals it.

Passages of WORDS words are found in the same search, by words in place of bytes
(passages.py); where a core has several runs, hashes of all their passages are exchanged.

Defined results: null and empty texts, and texts under `least` bytes, keep all;
repeated rows repeat each other; documents are told apart by their id together with a
64-bit hash of the text, so null or clashing ids do no harm; an empty table gives no
rows; very long texts are taken whole; other columns are ignored, whatever their names
(remove_repeats returns them as they are).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import passages
from .common import durable, lean, narrow_batches, parts, whole
from .jaccard import mix
from .passages import WORDS

LEAST = 400
WINDOW = 256
GRAM = 8
#: Anchors that a task holds before it sends them on; suffixes of one sorted run; anchors per bucket and suffixes per range.
HELD, RUN, BUCKET, RANGE = 1 << 20, 30_000, 400_000, 40_000
#: Groups up to this size are compared as a matrix, larger ones by one pass for each offset of the anchor.
MATRIX = 256

_ANCHOR = np.dtype([("core", "<u8"), ("run", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("at", "<u4"), ("low", "<u2"), ("high", "<u2"), ("known", "u1")])
_OWN = np.dtype([(n, _ANCHOR[n]) for n in ("core", "at", "low", "high", "known")])
_SPAN = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("first", "<u4"), ("last", "<u4")])
_BLOCKS = "bucket long, kind int, block binary"
_SPANS = "doc long, tag long, first long, last long"
#: Kinds of blocks: of byte strings, and of passages of words.
_BYTES, _WORDED = {"anchors": 0, "spans": 1, "several": 2}, {"anchors": 3, "spans": 4, "several": 5}
#: Columns beside those of the input, whatever names that has.
_KEY, _SPANNED = ["_binweave_doc", "_binweave_tag"], ["_binweave_spans", "_binweave_worded"]
_WORD = re.compile(r"\S+")


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def anchors(texts: list[bytes], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every run of strings: text number, anchor, first and last string start (in the text)."""
    data = np.frombuffer(b"".join(texts) + bytes(GRAM + WINDOW), np.uint8)
    n = len(data) - GRAM - WINDOW
    grams = np.empty(n + WINDOW, np.uint64)
    for k in range(GRAM):
        part = data[k : k + (len(grams) - k + GRAM - 1) // GRAM * GRAM]
        part = part[: len(part) // GRAM * GRAM].view("<u8")
        grams[k::GRAM][: len(part)] = part
    key = (mix(grams) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width < WINDOW:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(lengths) - lengths
    count = np.maximum(0, lengths - least + 1)
    starts = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
    at = (key[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    end = np.concatenate([new[1:], [len(at)]]) - 1 if len(at) else new
    text = np.searchsorted(begin + lengths, starts[new], "right")
    return text, at[new] - begin[text], starts[new] - begin[text], starts[end] - begin[text]


def _dealt(x: np.ndarray, bucket: np.ndarray, kind: int) -> pd.DataFrame:
    order = np.argsort(bucket, kind="stable")
    x, bucket = x[order], bucket[order]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    return pd.DataFrame({"bucket": bucket[np.concatenate([[0], cut])].astype(np.int64), "kind": kind, "block": [p.tobytes() for p in np.split(x, cut)]})


def _same_run(x: np.ndarray) -> np.ndarray:
    return (x["core"][1:] == x["core"][:-1]) & (x["run"][1:] == x["run"][:-1])


def _spans(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), _SPAN)
    out["doc"], out["tag"], out["first"], out["last"] = x["doc"], x["tag"], x["at"] - x["high"], x["at"] - x["low"]
    return out


def _joined(x: np.ndarray) -> np.ndarray:
    """Spans with those that continue one another joined."""
    if not len(x):
        return x
    x = np.sort(x)
    new = np.flatnonzero(np.concatenate([[True], (x["doc"][1:] != x["doc"][:-1]) | (x["tag"][1:] != x["tag"][:-1]) | (x["first"][1:] > x["last"][:-1] + 1)]))
    out = x[new].copy()
    out["last"] = np.maximum.reduceat(x["last"], new)
    return out


def _in_order(x: np.ndarray) -> np.ndarray:
    """Anchors in order of core, run, doc, tag and place."""
    x = x[np.argsort(x["core"], kind="stable")]
    same = x["core"][1:] == x["core"][:-1]
    tied = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    y = x[tied]
    x[tied] = y[np.lexsort((y["at"], y["tag"], y["doc"], y["run"], y["core"]))]
    return x


def _split_known(x: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Anchors in order -> those to pass on, of repeated runs only the first, marked known; spans of the repeated ones.

    across: repeated are runs of several documents, or of a row that stands twice.
    """
    same = _same_run(x)
    again = np.concatenate([[False], same])
    new = np.flatnonzero(~again)
    size = np.diff(np.concatenate([new, [len(x)]]))
    if across:
        same &= (x["doc"][1:] != x["doc"][:-1]) | (x["tag"][1:] != x["tag"][:-1]) | (x["at"][1:] == x["at"][:-1])
    known = np.repeat(np.maximum.reduceat(x["known"] | np.concatenate([[False], same]), new), size)
    # a run that is known from elsewhere holds for its members here as well
    covered = x[known.astype(bool) & (x["known"] == 0)]
    kept = ~again | (known == 0)
    out = x[kept]
    out["known"] = known[kept]
    return out, _spans(covered)


def _word_anchors(texts: list[str], raws: list[bytes], ids: np.ndarray, tags: np.ndarray, words: int) -> np.ndarray:
    text, at, first, last, core, run = passages.anchors(*passages.codes(texts, raws), words)
    x = np.zeros(len(text), _ANCHOR)
    x["doc"], x["tag"], x["at"], x["low"], x["high"], x["core"], x["run"] = ids[text], tags[text], at, at - last, at - first, core, run
    return x


def _byte_anchors(raws: list[bytes], ids: np.ndarray, tags: np.ndarray, least: int) -> np.ndarray:
    from xxhash import xxh3_64_intdigest as digest

    core = least - WINDOW + 1
    text, at, first, last = anchors(raws, least)
    x = np.zeros(len(text), _ANCHOR)
    x["doc"], x["tag"], x["at"], x["low"], x["high"] = ids[text], tags[text], at, at - last, at - first
    views = [memoryview(t) for t in raws]
    x["core"] = [digest(views[t][a : a + core]) for t, a in zip(text.tolist(), at.tolist(), strict=True)]
    x["run"] = [digest(views[t][f : e + least]) for t, f, e in zip(text.tolist(), first.tolist(), last.tolist(), strict=True)]
    return x


def _emit(docs: DataFrame, buckets: int, least: int | None, words: int | None, across: bool) -> DataFrame:
    """Blocks of anchors, by core, and of spans whose repetition shows within the task."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean()
        held: dict[bool, list[np.ndarray]] = {False: [], True: []}

        def send() -> Iterator[pd.DataFrame]:
            for worded, kinds in ((False, _BYTES), (True, _WORDED)):
                if not held[worded]:
                    continue
                x = _in_order(np.concatenate(held[worded]))
                held[worded] = []
                x, spans = _split_known(x, worded and across)
                yield _dealt(x, x["core"] % np.uint64(buckets), kinds["anchors"])
                if len(spans := _joined(spans)):
                    yield _dealt(spans, np.full(len(spans), int(x["doc"][0]) % buckets), kinds["spans"])

        for b in batches:
            ids, tags, rows = b["doc"].to_numpy(), b["tag"].to_numpy(), b["text"].to_list()
            i = 0
            while i < len(rows):
                j, size, texts = i, 0, []
                while j < len(rows) and size < 1 << 20:
                    texts.append(_raw(rows[j]))
                    size += len(texts[-1])
                    j += 1
                if least and len(x := _byte_anchors(texts, ids[i:j], tags[i:j], least)):
                    held[False].append(x)
                if words and len(x := _word_anchors(rows[i:j], texts, ids[i:j], tags[i:j], words)):
                    held[True].append(x)
                i = j
                if sum(len(x) for own in held.values() for x in own) > HELD:
                    yield from send()
        yield from send()

    return docs.mapInPandas(emit, _BLOCKS)


def _met(across: bool):
    """By bucket of cores: spans of runs that are repeated as a whole, and several: anchors whose core has several runs. Spans pass."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        lean()
        own = int(pdf["bucket"].iloc[0])
        out = [pdf[pdf["kind"].isin([_BYTES["spans"], _WORDED["spans"]])]]
        for worded, kinds in ((False, _BYTES), (True, _WORDED)):
            blocks = pdf.loc[pdf["kind"] == kinds["anchors"], "block"]
            if not len(blocks):
                continue
            x = _in_order(np.concatenate([np.frombuffer(b, _ANCHOR) for b in blocks]))
            x, spans = _split_known(x, worded and across)
            same = x["core"][1:] == x["core"][:-1]
            several = x[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
            out += [_dealt(y, np.full(len(y), own), kinds[k]) for y, k in ((_joined(spans), "spans"), (several, "several")) if len(y)]
        return pd.concat(out)

    return meet


def common(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix, of which `known` bytes are known."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    high -= 1
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Sorted strings as the lengths of their prefixes common with the one before, and what follows."""
    lcp, rest, before = [], [], b""
    for s in strings:
        n = common(before, s, 0)
        lcp.append(n)
        rest.append(s[n:])
        before = s
    return lcp, rest


def merge(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, bytes, int]]:
    """Front-coded sorted runs -> (run, number in the run, string, common prefix with the string before) in sorted order, by a loser tree."""
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = [None] * k
    lcp, at = [-1] * k, [-1] * k

    def advance(r: int) -> None:
        at[r] += 1
        if r < len(runs) and at[r] < len(runs[r][0]):
            n = runs[r][0][at[r]]
            heads[r] = (heads[r] or b"")[:n] + runs[r][1][at[r]]
            lcp[r] = n
        else:
            heads[r], lcp[r] = None, -1

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser's common prefix is from now on that with the winner."""
        if lcp[x] != lcp[y]:
            return (x, y) if lcp[x] > lcp[y] else (y, x)
        a, b = heads[x], heads[y]
        if a is None or b is None:
            return x, y
        n = common(a, b, lcp[x])
        if (a[n : n + 1], x) <= (b[n : n + 1], y):
            lcp[y] = n
            return x, y
        lcp[x] = n
        return y, x

    for r in range(k):
        advance(r)
    losers, row = [0] * k, list(range(k))
    level = k
    while len(row) > 1:
        level //= 2
        played = [play(row[i], row[i + 1]) for i in range(0, len(row), 2)]
        for i, (_, loser) in enumerate(played):
            losers[level + i] = loser
        row = [w for w, _ in played]
    winner = row[0]
    while heads[winner] is not None:
        yield winner, at[winner], heads[winner], lcp[winner]
        advance(winner)
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


_META = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("at", "<u4"), ("low", "<u2"), ("high", "<u2"), ("known", "u1"), ("lcp", "<u2"), ("rest", "<u2"), ("left", "<u2")])


def _sorted_run(entries: list[tuple], ranges: int) -> Iterator[pd.DataFrame]:
    """entries (core bytes + suffix, left context, doc, tag, at, low, high, known) -> front-coded blocks by range of cores."""
    entries.sort(key=lambda e: e[0])
    by: dict[int, list[tuple]] = {}
    for e in entries:
        by.setdefault(int.from_bytes(e[0][:8], "big") * ranges >> 64, []).append(e)
    rows = []
    for r, own in by.items():
        lcp, rest = front_code([e[0] for e in own])
        meta = np.zeros(len(own), _META)
        for k, name in enumerate(("doc", "tag", "at", "low", "high", "known"), 2):
            meta[name] = [e[k] for e in own]
        meta["lcp"], meta["rest"], meta["left"] = lcp, [len(x) for x in rest], [len(e[1]) for e in own]
        rows.append((r, len(own).to_bytes(4, "little") + meta.tobytes() + b"".join(rest) + b"".join(e[1] for e in own)))
    yield pd.DataFrame(rows, columns=["range", "block"]).assign(worded=False)


def _decoded(b: bytes) -> tuple[np.ndarray, list[int], list[bytes], list[bytes]]:
    n = int.from_bytes(b[:4], "little")
    meta = np.frombuffer(b, _META, n, 4)
    at, parts_ = 4 + n * _META.itemsize, []
    for name in ("rest", "left"):
        own = []
        for size in meta[name].tolist():
            own.append(b[at : at + size])
            at += size
        parts_.append(own)
    return meta, meta["lcp"].tolist(), parts_[0], parts_[1]


def repeated_offsets(right: list[int], lefts: list[bytes], low: list[int], high: list[int], known: list[int], least: int) -> list[list[tuple[int, int]]]:
    """For suffixes in sorted order: the ranges of offsets d (low to high) for which the string from d bytes before the anchor is another's as well.

    right[i]: common prefix of suffixes i - 1 and i; lefts: what stands before the anchors, reversed.
    """
    m = len(lefts)
    if m == 2:
        d = (least - right[1], common(lefts[0], lefts[1], 0))
        return [[(max(d[0], low[i]), min(d[1], high[i]))] if not known[i] and max(d[0], low[i]) <= min(d[1], high[i]) else [] for i in (0, 1)]
    order = sorted(range(m), key=lefts.__getitem__)
    left = np.array([0] + [common(lefts[a], lefts[b], 0) for a, b in zip(order, order[1:], strict=False)])
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    near, lo, hi = np.array(right), np.array(low), np.array(high)
    covered = np.zeros((m, WINDOW + 1), bool)
    if m <= MATRIX:
        def least_between(x: np.ndarray) -> np.ndarray:
            out = np.full((m, m), -1)
            for i in range(m - 1):
                out[i, i + 1 :] = out[i + 1 :, i] = np.minimum.accumulate(x[i + 1 :])
            return out

        prefix, suffix = least_between(near), least_between(left)[np.ix_(place, place)]
        a, b = np.maximum(least - prefix, lo[:, None]), np.minimum(suffix, hi[:, None])
        i, j = np.nonzero(a <= b)
        steps = np.zeros((m, WINDOW + 2), np.int64)
        np.add.at(steps, (i, a[i, j]), 1)
        np.add.at(steps, (i, b[i, j] + 1), -1)
        covered = np.cumsum(steps, axis=1)[:, : WINDOW + 1] > 0
    else:
        for d in range(int(lo.min()), int(hi.max()) + 1):
            own = np.flatnonzero((lo <= d) & (d <= hi))
            key = np.cumsum(near < least - d)[own] * (m + 1) + np.cumsum(left < d)[place[own]]
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            covered[own, d] = count[inverse] > 1
    out = []
    for i in range(m):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], covered[i].view(np.int8), [0]]))) if not known[i] else []
        out.append([(int(x), int(y) - 1) for x, y in zip(edge[::2], edge[1::2], strict=True)])
    return out


def _resolver(least: int):
    """Merge the sorted runs of a range of cores, and find the repeated strings of each anchor."""

    def resolve(blocks: list[bytes]) -> pd.DataFrame:
        runs = [_decoded(b) for b in blocks]
        found: list[tuple] = []
        group: list[tuple] = []

        def done() -> None:
            if len(group) < 2 or all(e[4] for e in group):
                return
            right, lefts, low, high, known = ([e[k] for e in group] for k in range(5))
            for e, offsets in zip(group, repeated_offsets(right, lefts, low, high, known, least), strict=True):
                found.extend((e[5], e[6], e[7] - y, e[7] - x) for x, y in offsets)

        cores = [[(int(x["low"]), int(x["high"]), int(x["known"]), int(x["doc"]), int(x["tag"]), int(x["at"])) for x in meta] for meta, *_ in runs]
        for r, i, _, lcp in merge([(lcp, rest) for _, lcp, rest, _ in runs]):
            if lcp < 8 and group:
                done()
                group = []
            group.append((max(0, lcp - 8), runs[r][3][i][::-1], *cores[r][i]))
        done()
        return pd.DataFrame(found, columns=["doc", "tag", "first", "last"]).astype("int64")

    return resolve


def _resolved(least: int | None, across: bool):
    """By range of cores: the repeated strings of bytes, and the repeated passages of words."""

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        lean()
        out = []
        if len(blocks := pdf.loc[~pdf["worded"], "block"].to_list()):
            out.append(_resolver(least)(blocks).assign(worded=False))
        if len(blocks := pdf.loc[pdf["worded"], "block"].to_list()):
            doc, tag, first, last = passages.repeated(blocks, across)
            out.append(pd.DataFrame({"doc": doc, "tag": tag, "first": first, "last": last}).assign(worded=True))
        return pd.concat(out)

    return resolve


def _unpacked_spans(met: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean()
        for b in batches:
            for kind, block in zip(b["kind"], b["block"], strict=True):
                x = np.frombuffer(block, _SPAN)
                yield pd.DataFrame({n: x[n].astype(np.int64) for n in x.dtype.names}).assign(worded=kind == _WORDED["spans"])

    return met.filter(F.col("kind").isin(_BYTES["spans"], _WORDED["spans"])).select("kind", "block").mapInPandas(rows, f"{_SPANS}, worded boolean")


def _unpacked_anchors(met: DataFrame) -> DataFrame:
    """(doc, tag, worded, anchor): each an _OWN record."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean()
        for b in batches:
            for kind, block in zip(b["kind"], b["block"], strict=True):
                x = np.frombuffer(block, _ANCHOR)
                own = np.zeros(len(x), _OWN)
                for n in _OWN.names:
                    own[n] = x[n]
                raw, size = own.tobytes(), _OWN.itemsize
                yield pd.DataFrame({"doc": x["doc"], "tag": x["tag"], "worded": kind == _WORDED["several"], "anchor": [raw[k : k + size] for k in range(0, len(raw), size)]})

    return met.filter(F.col("kind").isin(_BYTES["several"], _WORDED["several"])).select("kind", "block").mapInPandas(rows, "doc long, tag long, worded boolean, anchor binary")


def _passage_blocks(texts: list[str], raws: list[bytes], ids: list[int], tags: list[int], owns: list[np.ndarray], words: int, ranges: int) -> pd.DataFrame:
    """The hashes of the passages of the anchors, by range of cores."""
    code, count = passages.codes(texts, raws)
    size = np.array([len(x) for x in owns])
    text, x = np.repeat(np.arange(len(texts)), size), np.concatenate(owns)
    known, first = x["known"], x["at"].astype(np.int64) - x["high"]
    runs = x["high"].astype(np.int64) - x["low"] + 1
    (hashed,) = passages.hashes(code, words)
    head = passages.told(np.array(ids, np.int64)[text], np.array(tags, np.int64)[text], first, runs, known)
    begin = first + (np.cumsum(count) - count)[text]
    place = (x["core"] >> np.uint64(32)).astype(np.int64) * ranges >> 32
    order = np.argsort(place, kind="stable")
    edge = np.flatnonzero(np.diff(place[order])) + 1
    rows = [(int(place[k[0]]), True, passages.block(head[k], hashed[passages.spread(begin[k], runs[k])])) for k in np.split(order, edge)]
    return pd.DataFrame(rows, columns=["range", "worded", "block"])


def repeated_spans(docs: DataFrame, least: int | None = LEAST, words: int | None = None, across: bool = False) -> DataFrame:
    """docs(doc, tag, text) -> (doc, tag, first, last, worded): ranges of starts of strings of `least` bytes that start elsewhere too.

    worded: ranges of numbers of words at which passages of `words` words start that stand elsewhere too, or (across) in another row.
    """
    assert least is None or least - WINDOW + 1 > GRAM
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = total * 2 // WINDOW * bool(least) + total // 100 * bool(words)
    buckets = max(parts(docs.sparkSession), found // BUCKET + 1)
    met = durable(_emit(docs, buckets, least, words, across).groupBy("bucket").applyInPandas(_met(across), _BLOCKS), "suffix-anchors")
    chosen = lambda worded: F.collect_list(F.when(F.col("worded") == worded, F.col("anchor")))
    wanted = _unpacked_anchors(met).groupBy("doc", "tag").agg(chosen(False).alias("anchors"), chosen(True).alias("worded"))
    n = met.filter(F.col("kind").isin(_BYTES["several"], _WORDED["several"])).agg(F.sum(F.octet_length("block"))).first()[0] or 0
    ranges = max(parts(docs.sparkSession), n // _ANCHOR.itemsize // RANGE + 1)
    own = lambda records: np.frombuffer(b"".join(records), _OWN)

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean()
        held: list[tuple] = []
        taken: list[tuple] = []
        size = 0
        for b in batches:
            for doc, tag, text, byte, worded in zip(b["doc"], b["tag"], b["text"], b["anchors"], b["worded"], strict=True):
                raw = _raw(text)
                for core, at, low, high, known in own(byte).tolist():
                    held.append((core.to_bytes(8, "big") + raw[at : at - low + least], raw[at - high : at], doc, tag, at, low, high, known))
                if len(held) > RUN:
                    yield from _sorted_run(held, ranges)
                    held = []
                if len(worded):
                    taken.append((text, raw, doc, tag, own(worded)))
                    size += len(raw)
                if size > 1 << 20:
                    yield _passage_blocks(*map(list, zip(*taken, strict=True)), words, ranges)
                    taken, size = [], 0
        if held:
            yield from _sorted_run(held, ranges)
        if taken:
            yield _passage_blocks(*map(list, zip(*taken, strict=True)), words, ranges)

    # a row that stands twice comes twice; its runs are known to be repeated, and only serve others
    runs = docs.join(wanted, ["doc", "tag"]).mapInPandas(fetch, "range long, worded boolean, block binary")
    return _unpacked_spans(met).unionByName(runs.groupBy("range").applyInPandas(_resolved(least, across), f"{_SPANS}, worded boolean"))


def _kept(raw: bytes, spans: list, least: int) -> tuple[list[tuple[int, int]], bytes]:
    """The maximal removed byte ranges, and the remaining bytes."""
    removed: list[list[int]] = []
    for a, b in sorted((x["first"], x["last"] + least) for x in spans):
        if removed and a <= removed[-1][1]:
            removed[-1][1] = max(removed[-1][1], b)
        else:
            removed.append([a, b])
    parts_, at = [], 0
    for a, b in removed:
        parts_.append(raw[at:a])
        at = b
    return [(a, b) for a, b in removed], b"".join([*parts_, raw[at:]])


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with the columns _KEY: a row's id, and a hash of its text (and of the id being null)."""
    return docs.withColumns({_KEY[0]: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), _KEY[1]: F.xxhash64(F.col("doc_id").isNull(), "text")})


def _texts(keyed: DataFrame) -> DataFrame:
    return keyed.select(F.col(_KEY[0]).alias("doc"), F.col(_KEY[1]).alias("tag"), whole("text").alias("text"))


def _collected(worded: bool) -> Column:
    return F.collect_list(F.when(F.col("worded") == worded, F.struct("first", "last")))


def _with_spans(docs: DataFrame, least: int | None, words: int | None, across: bool = False) -> DataFrame:
    """docs with the columns _KEY and _SPANNED (arrays of the spans of bytes and of words, may be null)."""
    narrow_batches(docs.sparkSession, 500)
    keyed = _keyed(docs)
    # a text of n words has 2 n - 1 bytes at least
    enough = min(x for x in (least, words and 2 * words - 1) if x)
    spans = repeated_spans(_texts(keyed).filter(F.octet_length("text") >= enough), least, words, across)
    own = spans.groupBy(F.col("doc").alias(_KEY[0]), F.col("tag").alias(_KEY[1])).agg(_collected(False).alias(_SPANNED[0]), _collected(True).alias(_SPANNED[1]))
    return keyed.join(own, _KEY, "left")


def _covered(spans: list, words: int) -> tuple[int, int]:
    """The number of words in passages that start at the words of the spans, and of their unbroken stretches."""
    total, stretches, end = 0, 0, -1
    for a, b in sorted((x["first"], x["last"] + words) for x in spans):
        stretches += a > end
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total, stretches


def dedup_documents(docs: DataFrame, least: int = LEAST, words: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what remains.

    With words also shared_words and shared_passages: the words in passages of that many words that stand in another
    document too, and their unbroken stretches; nothing is removed for them.
    """
    further = ["shared_words", "shared_passages"] if words else []

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean()
        for b in batches:
            rows = []
            for doc_id, text, spans, worded in zip(b["doc_id"], b["text"], b["spans"], b["worded"], strict=True):
                raw = _raw(text)
                removed, kept = _kept(raw, [] if spans is None else spans, least)
                rows.append((doc_id, len(raw), len(raw) - len(kept), len(removed), hashlib.sha256(kept).hexdigest(), *(_covered([] if worded is None else worded, words) if words else ())))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *further])

    spanned = _with_spans(docs.select("doc_id", "text"), least, words, across=True)
    spanned = spanned.select(F.col("doc_id").cast("string").alias("doc_id"), whole("text").alias("text"), F.col(_SPANNED[0]).alias("spans"), F.col(_SPANNED[1]).alias("worded"))
    schema = ", ".join(["doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string", *(f"{c} long" for c in further)])
    return spanned.mapInPandas(digests, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def _bytes_of_words(text: str, spans: list, words: int) -> list[tuple[int, int]]:
    """Byte ranges of the passages that start at the words of the spans."""
    if spans is None or not len(spans):
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    size = np.concatenate([[0], np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in text])]) if not text.isascii() else range(len(text) + 1)
    return [(int(size[at[x["first"]][0]]), int(size[at[x["last"] + words - 1][1]])) for x in spans]


def remove_repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents with every passage of that many words that stands elsewhere too, here or there, cut out of their texts; all copies go."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans, strict=True):
            ranges = [{"first": a, "last": b} for a, b in _bytes_of_words(t, s, words)] if t is not None else []
            out.append(_kept(_raw(t), ranges, 0)[1].decode("utf-8", "surrogatepass") if ranges else t)
        return pd.Series(out, index=texts.index, dtype=object)

    return _with_spans(docs, None, words).withColumn("text", cut("text", _SPANNED[1])).select(*docs.columns)
