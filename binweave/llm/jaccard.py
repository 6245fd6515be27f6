"""Exact Jaccard join of word-shingle sets: universe partition with the pigeonhole principle.

Sets fall into size bands (widths grow by 4/3). For band k, the smaller set of a
linked pair has at most U_k shingles, so the two differ in at most H_k. The universe
of shingles is hashed into m_k > H_k segments; two linked sets agree on at least
m_k - H_k of them. A set's signatures are the hashes of its segments' contents, for
each band in which the smaller set of a pair with it may lie.

In small bands, and for sets that leave too many segments empty, H + 1 coarser segments
are indexed by their contents and by their one-deletion neighbourhoods (the contents
less one shingle). A set spends 0, 1 (equal) or 2 (at most one shingle apart) on each
segment, H + 1 in all: if every segment differed by what is spent on it, the sets would
differ in H + 1. Empty segments, and neighbourhoods of single shingles, would be the
same for everyone; they are neither indexed nor spent on. The few sets that then can't
spend enough find one another by prefixes of their shingles.

Cost-based allocation: a signature costs as many comparisons as sets have it, known
from a first exchange. Signatures that no other set shares cost nothing. A set asks for
the rarest ones that suffice: of its segments all but (agreements needed - 1), of the
coarse ones what remains when the dearest units beyond H + 1 are struck off. It is found
by all that it has.

Signatures travel packed: a task sends one block to each bucket of signatures. Sets
that share a signature are candidates. First each group's most popular member is
compared with the others; then only pairs whose sets aren't yet connected, and
whose parity bitmaps differ in at most H bits, a lower bound of their difference.
Large groups are cut into blocks by size band, and each two blocks meet in a task.
All candidates are verified on the whole sets; links become components.

Sets are told apart by 128 bits: 64 name them; where two sets of different other 64 bits
have one name, the work is done anew with those named by the other half.

Defined results: null and empty texts, and texts of white space, have the empty set,
linked with nothing; repeated rows are equal sets; a row without an id is counted
but linked with nothing, its component is null; texts of under five words are one
shingle; very long texts are taken whole; an empty table gives no rows; other columns
are ignored, whatever their names (keep_one returns them as they are).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, lean, narrow_batches, parts
from .components import components

WORDS = 5
#: Linked if UNDER * intersection >= OVER * union.
OVER, UNDER = 75, 100
#: Bands up to this size use neighbourhoods.
SMALL = 32
#: Sets that a task knows it has sent, and sets that may be named anew.
SEEN, RENAMED = 1 << 20, 100_000
#: Bytes of text per bucket of signatures, and entries that a task holds before it sends them on.
BUCKET_BYTES, HELD = 8 << 20, 1 << 20
BITS = 1024
#: Pairs looked at in one step, and rows gathered before whole groups are looked at.
AT_ONCE, GATHERED = 1 << 16, 20_000
#: Groups of more sets than this are cut into blocks of about as many, and two blocks meet in a task of their own.
BLOCK = 2048
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    delimiter = np.zeros(256, bool)
    delimiter[[0x20, *range(0x09, 0x0E)]] = True
    at = 0
    while at < len(texts):  # about a megabyte at once
        size, to = 0, at
        while to < len(texts) and size < 1 << 20:
            size += len(texts[to] or "")
            to += 1
        raw = [(t or "").encode("utf-8", "surrogatepass").lower() + b" " for t in texts[at:to]]
        data = np.frombuffer(b"".join(raw), np.uint8)
        inside = ~delimiter[data]
        edge = np.diff(np.concatenate([[0], inside.view(np.int8)]))
        begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        ends = np.searchsorted(begin, np.cumsum([len(x) for x in raw]))
        if len(begin):
            length = stop - begin
            where = np.flatnonzero(inside)
            nth = np.arange(len(where)) - np.repeat(np.cumsum(length) - length, length)
            chars = mix((nth.astype(np.uint64) << np.uint64(8)) + data[where] + np.uint64(1))
            words = mix(np.add.reduceat(chars, np.cumsum(length) - length))
            grams = words[: max(0, len(words) - WORDS + 1)].copy()
            for k in range(1, WORDS):
                grams = mix(grams * _PRIME + words[k : len(words) - WORDS + 1 + k]) if len(grams) else grams
        a = 0
        for b in ends:
            if b - a >= WORDS:
                yield np.unique(grams[a : b - WORDS + 1])
            elif b > a:
                short = words[a:a + 1].copy()
                for k in range(a + 1, b):
                    short = mix(short * _PRIME + words[k])
                yield mix(short + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
            a = b
        at = to


@cache
def bands() -> tuple[list[int], list[int], list[int]]:
    """Lower bounds of the bands, the most that linked sets can differ if the smaller one lies there, and the number of segments."""
    low, differ, segments = [1], [], []
    while low[-1] < 1 << 40:
        low.append(max(low[-1] + 1, -(-low[-1] * 4 // 3)))
        small = low[-1] - 1
        h = (small + small * UNDER // OVER) // 7
        differ.append(h)
        segments.append(h + 1 + h // 4)
    return low, differ, segments


def band_of(n: int) -> int:
    return int(np.searchsorted(bands()[0], n, "right")) - 1


def digests(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set; (-1, -1) for the empty one."""
    if not len(s):
        return -1, -1
    n = np.array([len(s)], np.uint64)
    out = []
    for seed in (np.uint64(0), _PRIME):
        own = mix(s + seed) if seed else s
        out.append(int(mix((own.sum(dtype=np.uint64)[None] + (n + seed)) ^ mix(np.bitwise_xor.reduce(own)[None]))[0].astype(np.int64)))
    return out[0] if out[0] != -1 else 0, out[1]


def _sums(own: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles in order of their segments -> (segment of each, its mixed hash, where segments begin, their sums)."""
    order = np.argsort(seg, kind="stable")
    seg, mixed = seg[order], mix(own[order])
    first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    return seg, mixed, first, np.add.reduceat(mixed, first)


def neighbourhoods(s: np.ndarray, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(units to spare, or less than 0; signatures; parts) of the coarse segments of band k.

    A part is 1 + 4 * segment + 2 if the segment may take two units + 1 for a neighbour.
    """
    count = bands()[1][k] + 1
    own = mix(s + np.uint64((k + 1) * int(_PRIME) % (1 << 64)))
    seg, mixed, first, sums = _sums(own, own % np.uint64(count))
    size = np.diff(np.concatenate([first, [len(seg)]]))
    salt = mix(seg[first] + np.uint64((k << 32) + (1 << 63)))
    two = size > 1
    each = np.repeat(np.arange(len(first)), size)
    near = np.flatnonzero(two[each])
    sigs = np.concatenate([mix(sums + salt), mix(sums[each[near]] - mixed[near] + salt[each[near]])])
    head = 1 + 4 * seg[first].astype(np.int64) + 2 * two
    return int((1 + two).sum()) - count, sigs, np.concatenate([head, head[each[near]] + 1])


def signatures(s: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | int]]:
    """(family, need, signatures, parts) of a set, for every band that matters.

    Families 3k: segments of band k; 3k + 2: shingles; need is the agreements needed, part 0.
    3k + 1: neighbourhoods; need is 1 + the units to spare, 0 where a set can't spend enough.
    """
    n = len(s)
    _, differ, segments = bands()
    for k in range(band_of(-(-n * OVER // UNDER)), band_of(n) + 1):
        needed = 0
        if bands()[0][k + 1] - 1 > SMALL:
            own = mix(s + np.uint64((k + 1) * int(_PRIME) % (1 << 64)))
            seg, _, first, sums = _sums(own, own % np.uint64(segments[k]))
            needed = len(first) - differ[k]
            yield 3 * k, max(1, needed), mix(sums + mix(seg[first] + np.uint64(k << 32))), 0
        if needed < 1:
            spare, sigs, parts_ = neighbourhoods(s, k)
            yield 3 * k + 1, max(0, spare + 1), sigs, parts_
            if spare < 0:
                yield 3 * k + 2, -(-n * OVER // UNDER), mix(s + np.uint64(k << 32)), 0


_ENTRY = np.dtype([("sig", "<u8"), ("set", "<i8"), ("family", "<u2"), ("part", "<u4")])
_MET = np.dtype([("sig", "<u8"), ("set", "<i8"), ("family", "<u2"), ("part", "<u4"), ("group", "<u4")])
_NEED = np.dtype([("set", "<i8"), ("family", "<u2"), ("need", "<u4")])
_PROBE = np.dtype([("sig", "<u8"), ("set", "<i8"), ("popular", "<f4"), ("ask", "u1")])


def _packed(x: np.ndarray) -> bytes:
    """Entries grouped by (set, family): its head, the number of signatures, and their low 40 bits; then the parts, if there are any."""
    x = x[np.lexsort((x["sig"], x["family"], x["set"]))]
    new = np.flatnonzero(np.concatenate([[True], (x["set"][1:] != x["set"][:-1]) | (x["family"][1:] != x["family"][:-1])]))
    count = np.diff(np.concatenate([new, [len(x)]])).astype("<u4")
    five = np.ascontiguousarray(x["sig"]).view(np.uint8).reshape(-1, 8)[:, :5]
    head = np.array([len(new), len(x)], "<u4").tobytes()
    return b"".join([head, x["set"][new].tobytes(), x["family"][new].tobytes(), count.tobytes(), five.tobytes(), x["part"].tobytes() if x["part"].any() else b""])


def _signatures_of(b: bytes) -> np.ndarray:
    """The signatures of a packed block."""
    n, size = np.frombuffer(b, "<u4", 2).tolist()
    wide = np.zeros((size, 8), np.uint8)
    wide[:, :5] = np.frombuffer(b, np.uint8, 5 * size, 8 + 14 * n).reshape(-1, 5)
    return wide.view("<u8")[:, 0]


def _unpacked(b: bytes, wanted: np.ndarray) -> np.ndarray:
    """The entries of a packed block whose signatures are among the wanted ones (sorted)."""
    n, size = np.frombuffer(b, "<u4", 2).tolist()
    sets, families, count = np.frombuffer(b, "<i8", n, 8), np.frombuffer(b, "<u2", n, 8 + 8 * n), np.frombuffer(b, "<u4", n, 8 + 10 * n)
    sigs = _signatures_of(b)
    keep = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, sigs), len(wanted) - 1)] == sigs) if len(wanted) else np.zeros(0, np.int64)
    head = np.repeat(np.arange(n), count)[keep]
    out = np.zeros(len(keep), _ENTRY)
    out["sig"], out["set"], out["family"] = sigs[keep], sets[head], families[head]
    at = 8 + 14 * n + 5 * size
    if len(b) > at:
        out["part"] = np.frombuffer(b, "<u4", size, at)[keep]
    return out


def _dealt(x: np.ndarray, bucket: np.ndarray, kind: int, pack) -> pd.DataFrame:
    order = np.argsort(bucket, kind="stable")
    x, bucket = x[order], bucket[order]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    return pd.DataFrame({"bucket": bucket[np.concatenate([[0], cut])].astype(np.int64), "kind": kind, "block": [pack(p) for p in np.split(x, cut)]})


_BLOCKS = "bucket long, kind int, block binary"


def _emit(docs: DataFrame, buckets: int, renamed: frozenset[int]) -> DataFrame:
    """Blocks by bucket. Kind 0: signature entries, by signature. Kind 1: what sets need, by set. Kind 2: (doc_id, size, set, other half), by task."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean()
        held: tuple[list[np.ndarray], list[np.ndarray]] = [], []  # entries without and with parts
        needs: list[tuple] = []
        size, seen = 0, set()

        def send() -> Iterator[pd.DataFrame]:
            nonlocal needs, size
            for own in held:
                if own:
                    x = np.concatenate(own)
                    yield _dealt(x, (x["sig"] >> np.uint64(40)) % np.uint64(buckets), 0, _packed)
                    own.clear()
            if needs:
                y = np.array(needs, _NEED)
                yield _dealt(y, y["set"] % buckets, 1, lambda p: p.tobytes())
            needs, size = [], 0

        for b in batches:
            own = np.zeros((len(b), 4), np.int64)
            for i, (doc_id, s) in enumerate(zip(b["doc_id"].to_numpy(), shingle_sets(b["text"].to_list()), strict=True)):
                key, other = digests(s)
                if key in renamed:
                    key = other
                own[i] = doc_id, len(s), key, other
                if not len(s) or key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                for family, need, sigs, parts_ in signatures(s):
                    x = np.zeros(len(sigs), _ENTRY)
                    x["sig"], x["set"], x["family"], x["part"] = sigs, key, family, parts_
                    held[family % 3 == 1].append(x)
                    needs.append((key, family, need))
                    size += len(x)
                if size > HELD:
                    yield from send()
            if len(own):
                yield pd.DataFrame({"bucket": own[:1, 0] % buckets, "kind": 2, "block": [own.tobytes()]})
        yield from send()

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInPandas(emit, _BLOCKS)


def _met(buckets: int):
    """By bucket of signatures: the entries whose signature several sets have go on to the buckets of their sets; other kinds pass."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        lean()
        rest = pdf[pdf["kind"] != 0]
        blocks = pdf.loc[pdf["kind"] == 0, "block"]
        if not len(blocks):
            return rest
        # signatures that come once are most; only the others' entries are unpacked
        sigs = np.sort(np.concatenate([_signatures_of(b) for b in blocks]))
        again = np.unique(sigs[1:][sigs[1:] == sigs[:-1]])
        del sigs
        x = np.concatenate([_unpacked(b, again) for b in blocks])
        x = np.unique(x)  # by signature, then set
        if not len(x):
            return rest
        new = np.flatnonzero(np.concatenate([[True], x["sig"][1:] != x["sig"][:-1]]))
        count = np.diff(np.concatenate([new, [len(x)]]))
        group = np.repeat(count, count)
        keep = group > 1
        out = np.zeros(int(keep.sum()), _MET)
        for name in ("set", "family", "part"):
            out[name] = x[name][keep]
        # the bucket's number comes back in, as only 40 bits of the signature travelled
        out["sig"] = mix(x["sig"][keep] * _PRIME + np.uint64(int(pdf["bucket"].iloc[0])))
        out["group"] = group[keep]
        if not len(out):
            return rest
        return pd.concat([rest, _dealt(out, out["set"] % buckets, 3, lambda p: p.tobytes())])

    return meet


def _asked(met: np.ndarray, new: np.ndarray, count: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether each signature of a set's family 3k or 3k + 2, rarest first, is among those that suffice."""
    rank = np.arange(len(met)) - np.repeat(new, count)
    return (rank < np.repeat(count - least + 1, count)) & np.repeat(count >= least, count)


def _spent(met: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Whether a set asks for each signature of a family 3k + 1. spare: the units it may strike off, less than 0 if it asks for none.

    A unit is a segment's content, or (the second one) its neighbourhood, at the sum of its groups; the second is struck off first.
    """
    order = np.lexsort((met["part"], met["family"], met["set"]))
    x = met[order]
    unit = x["part"] - 1
    other = lambda *names: np.concatenate([[True], np.logical_or.reduce([x[n][1:] != x[n][:-1] for n in names])])
    new = np.flatnonzero(other("set", "family", "part"))
    cost = np.add.reduceat(x["group"].astype(np.float64), new)
    segment = np.cumsum(np.concatenate([[True], (unit[new][1:] >> 2 != unit[new][:-1] >> 2) | other("set", "family")[new][1:]])) - 1
    dearest = np.zeros(segment[-1] + 1)
    np.maximum.at(dearest, segment, cost)
    second = unit[new] & 1
    # a content that may take two units stands for both, if its neighbourhood is shared by none
    alone = ((unit[new] & 2) > 0) & (second == 0) & (np.bincount(segment, second)[segment] == 0)
    weight = np.where(alone, 2, 1)
    cost = np.where(second == 1, dearest[segment], cost)
    family = np.cumsum(other("set", "family"))[new] - 1
    by = np.lexsort((-second, -cost, family))
    begin = np.flatnonzero(np.concatenate([[True], family[by][1:] != family[by][:-1]]))
    upto = np.cumsum(weight[by])
    upto -= np.repeat(upto[begin] - weight[by][begin], np.diff(np.concatenate([begin, [len(by)]])))
    ask = np.zeros(len(new), bool)
    own = spare[order][new][by]
    ask[by] = (upto > own) & (own >= 0)
    out = np.zeros(len(met), bool)
    out[order] = np.repeat(ask, np.diff(np.concatenate([new, [len(x)]])))
    return out


def _probes(buckets: int):
    """By bucket of sets: for every set its shared signatures that it asks for, and those by which it may be found, dealt by signature."""

    def probe(pdf: pd.DataFrame) -> pd.DataFrame:
        lean()
        none = pd.DataFrame({"bucket": [], "kind": [], "block": []})
        met, need = (np.concatenate([np.zeros(0, d), *(np.frombuffer(b, d) for b in pdf.loc[pdf["kind"] == k, "block"])]) for k, d in ((3, _MET), (1, _NEED)))
        if not len(met):
            return none
        need = np.unique(need)
        met = met[np.lexsort((met["sig"], met["group"], met["family"], met["set"]))]
        new = np.flatnonzero(np.concatenate([[True], (met["set"][1:] != met["set"][:-1]) | (met["family"][1:] != met["family"][:-1])]))
        count = np.diff(np.concatenate([new, [len(met)]]))
        heads = np.zeros(len(new), [("set", "<i8"), ("family", "<u2")])
        heads["set"], heads["family"] = met["set"][new], met["family"][new]
        known = np.zeros(len(need), heads.dtype)
        known["set"], known["family"] = need["set"], need["family"]
        least = need["need"][np.searchsorted(known, heads)].astype(np.int64)
        ask = _asked(met, new, count, least)
        near = met["family"] % 3 == 1
        if near.any():
            ask[near] = _spent(met[near], np.repeat(least, count)[near] - 1)
        take = ask | near
        out = np.zeros(int(take.sum()), _PROBE)
        out["sig"], out["set"], out["ask"] = met["sig"][take], met["set"][take], ask[take]
        out["popular"] = np.repeat(np.add.reduceat(met["group"].astype(np.float64), new) / count, count)[take]
        if not len(out):
            return none
        return _dealt(out, (out["sig"] % np.uint64(buckets)).astype(np.int64), 4, lambda p: p.tobytes())

    return probe


def _groups(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The probes of one bucket in groups of a signature that some set asks for; those that ask stand first, the most popular set before all."""
    x = np.concatenate([np.zeros(0, _PROBE), *(np.frombuffer(b, _PROBE) for b in pdf["block"])])
    x = x[np.lexsort((x["set"], -x["popular"], 1 - x["ask"], x["sig"]))]
    for wanted in (False, True):
        new = np.flatnonzero(np.concatenate([[True], x["sig"][1:] != x["sig"][:-1]])) if len(x) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate([new, [len(x)]]))
        if not wanted:
            x = x[np.repeat((x["ask"][new] > 0) & (count > 1), count)] if len(x) else x
    return x, new, count


def _stars(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of each group's most popular set with the others."""
    lean()
    x, new, count = _groups(pdf)
    centre = np.repeat(x["set"][new], count)
    pairs = np.unique(np.stack([centre, x["set"]], axis=1)[centre != x["set"]], axis=0) if len(x) else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})


def _members(pdf: pd.DataFrame) -> pd.DataFrame:
    lean()
    x, _, _ = _groups(pdf)
    return pd.DataFrame({"sig": x["sig"].view(np.int64), "set": x["set"], "ask": x["ask"].astype(bool)})


def parity(s: np.ndarray) -> bytes:
    """Bit i: whether an odd number of shingles hash to i. Two sets differ in at least as many shingles as their bitmaps in bits."""
    odd = np.bincount((s % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _unlike_roots(x: pd.DataFrame) -> pd.DataFrame:
    """Whole groups of a sig in turn, those that ask first -> pairs of different roots in a group, one of which asks, that their sizes and bitmaps don't rule out."""
    sig, sets, roots, n, ask = (x[c].to_numpy() for c in ("sig", "set", "root", "n", "ask"))
    bits = np.frombuffer(b"".join(x["bits"]), np.uint64).reshape(len(x), -1)
    new = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    end = np.repeat(np.concatenate([new[1:], [len(x)]]), np.diff(np.concatenate([new, [len(x)]])))
    later = np.where(ask, end - np.arange(len(x)) - 1, 0)  # rows of its group that follow
    upto = np.cumsum(later)
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    a = 0
    while a < len(x):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + AT_ONCE, "right")))
        own = later[a:b]
        i = np.repeat(np.arange(a, b), own)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        ok = (roots[i] != roots[j]) & (np.minimum(n[i], n[j]) * UNDER >= np.maximum(n[i], n[j]) * OVER)
        i, j = i[ok], j[ok]
        for k in range(0, len(i), AT_ONCE):
            p, q = i[k : k + AT_ONCE], j[k : k + AT_ONCE]
            ok = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1, dtype=np.int64) <= (n[p] + n[q]) // 7
            us.append(np.minimum(sets[p[ok]], sets[q[ok]]))
            vs.append(np.maximum(sets[p[ok]], sets[q[ok]]))
        a = b
    return pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)}).drop_duplicates()


def _apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (sig, set, ask, root, n, bits), whole groups of a sig in turn -> what _unlike_roots finds, some thousand rows at once."""
    lean()
    held: list[pd.DataFrame] = []
    size = 0
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        size += len(b)
        if size < GATHERED or held[0]["sig"].iloc[0] == b["sig"].iloc[-1]:
            continue
        x = pd.concat(held)
        last = x["sig"].to_numpy() == b["sig"].iloc[-1]
        yield _unlike_roots(x[~last])
        held = [x[last]]
        size = len(held[0])
    if size:
        yield _unlike_roots(pd.concat(held))


def _facing(pdf: pd.DataFrame) -> pd.DataFrame:
    """Two blocks of one group (side 0 and 1) -> the pairs across them that _unlike_roots would find; bitmaps meet as a matrix product."""
    lean()
    x, y = (pdf[pdf["side"] == side] for side in (0, 1))
    if not len(x) or not len(y):  # a block may be empty
        return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
    odd = lambda own: np.unpackbits(np.frombuffer(b"".join(own["bits"]), np.uint8).reshape(len(own), -1), axis=1).astype(np.float32)
    bits = odd(y).T
    sets, roots, n, ask = (y[c].to_numpy() for c in ("set", "root", "n", "ask"))
    ones, found = bits.sum(axis=0), [np.zeros((0, 2), np.int64)]
    for at in range(0, len(x), 512):
        own = x.iloc[at : at + 512]
        left = odd(own)
        m = own["n"].to_numpy()[:, None]
        apart = left.sum(axis=1)[:, None] + ones - 2 * (left @ bits)  # whole numbers up to BITS, exact
        ok = (apart <= (m + n) // 7) & (own["root"].to_numpy()[:, None] != roots) & (own["ask"].to_numpy()[:, None] | ask) & (np.minimum(m, n) * UNDER >= np.maximum(m, n) * OVER)
        i, j = np.nonzero(ok)
        u, v = own["set"].to_numpy()[i], sets[j]
        found.append(np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})


def _blocked(rows: DataFrame, block: int) -> DataFrame:
    """Rows (sig, set, ask, root, n, bits) of large groups -> pairs. Blocks are dealt by size band and asking, so that only bands that can be linked meet, and no two blocks of which neither asks."""
    cell = ["sig", "band", "ask"]
    banded = rows.withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.34))).cast("int"))  # linked sizes are at most 4 / 3 apart: one band
    blocks = banded.groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = banded.join(blocks, cell).withColumn("k", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")).drop("blocks")
    every = blocks.select(*cell, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    one, other = every.alias("a"), every.alias("b")
    step = F.col("b.band") - F.col("a.band")
    later = (step == 1) | ((step == 0) & (F.struct("a.ask", "a.k") <= F.struct("b.ask", "b.k")))
    pairs = one.join(other, (F.col("a.sig") == F.col("b.sig")) & later & (F.col("a.ask") | F.col("b.ask")))
    pairs = pairs.withColumn("pair", F.xxhash64("a.sig", "a.band", "a.ask", "a.k", "b.band", "b.ask", "b.k"))
    side = lambda name, i: placed.join(pairs.select(*(F.col(f"{name}.{c}").alias(c) for c in (*cell, "k")), "pair"), [*cell, "k"]).select("pair", F.lit(i).alias("side"), "set", "root", "n", "ask", "bits")
    return side("a", 0).unionAll(side("b", 1)).groupBy("pair").applyInPandas(_facing, "u long, v long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole sets are alike enough."""
    a, b = sets.select(F.col("set").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("set").alias("v"), F.col("shingles").alias("b"))
    both = pairs.join(b, "v").join(a, "u")
    inter = F.size(F.array_intersect("a", "b"))
    return both.filter(inter * UNDER >= (F.size("a") + F.size("b") - inter) * OVER).select("u", "v")


def _counted(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """need(doc_id, set) rows' shingles and bitmaps."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean()
        for b in batches:
            own = list(shingle_sets(b["text"].to_list()))
            yield pd.DataFrame({"set": b["set"], "n": [len(s) for s in own], "shingles": [s.view(np.int64) for s in own], "bits": [parity(s) for s in own]})

    return docs.select("doc_id", "text").join(sets, "doc_id").select("set", "text").mapInPandas(fetch, "set long, n long, shingles array<long>, bits binary").dropDuplicates(["set"])


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) -> (doc_id, n_shingles, set) of every row, and the components of linked sets (u, root)."""
    spark = docs.sparkSession
    narrow_batches(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(parts(spark), -(-total // BUCKET_BYTES))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean()
        for b in batches:
            for block in b["block"]:
                x = np.frombuffer(block, np.int64).reshape(-1, 4)
                yield pd.DataFrame({"doc_id": x[:, 0], "n_shingles": x[:, 1], "set": x[:, 2], "other": x[:, 3]})

    renamed: frozenset[int] = frozenset()
    while True:
        met = durable(_emit(docs, buckets, renamed).groupBy("bucket").applyInPandas(_met(buckets), _BLOCKS), "jaccard-met")
        sized = met.filter("kind = 2").select("block").mapInPandas(rows, "doc_id long, n_shingles long, set long, other long")
        # of n sets n * n / 2^65 pairs can be expected here: none or a handful
        clash = sized.groupBy("set").agg(F.min("other").alias("a"), F.max("other").alias("b")).filter("a <> b").select("set").limit(RENAMED).collect()
        if not clash:
            break
        renamed |= {r["set"] for r in clash}
        discard(met)
    sized = sized.drop("other")
    probes = durable(met.filter("kind in (1, 3)").groupBy("bucket").applyInPandas(_probes(buckets), _BLOCKS), "jaccard-probes")
    stars = durable(probes.groupBy("bucket").applyInPandas(_stars, "u long, v long").distinct(), "jaccard-stars")
    wanted = stars.select(F.col("u").alias("set")).unionAll(stars.select(F.col("v").alias("set"))).distinct()
    first = sized.groupBy("set").agg(F.min("doc_id").alias("doc_id")).join(wanted, "set", "left_semi")
    sets = durable(_counted(docs, first), "jaccard-sets")
    near = _verified(stars, sets)
    near = durable(near, "jaccard-links")
    roots = components(near)
    named = sets.select("set", "n", "bits").join(roots.withColumnRenamed("u", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    members = probes.groupBy("bucket").applyInPandas(_members, "sig long, set long, ask boolean").join(named.select("set", "root"), "set")
    # groups of one component are settled
    members = durable(members, "jaccard-members")
    mixed = members.groupBy("sig").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("c")).filter("a <> b").select("sig", "c")
    unlike = members.join(mixed, "sig").join(named.select("set", "n", "bits"), "set")
    small = unlike.filter(F.col("c") <= BLOCK).drop("c").repartition(buckets, "sig").sortWithinPartitions("sig", F.desc("ask")).mapInPandas(_apart, "u long, v long")
    large = None
    if (mixed.agg(F.max("c")).first()[0] or 0) > BLOCK:
        large = durable(unlike.filter(F.col("c") > BLOCK).drop("c"), "jaccard-large")
    apart = durable((small.unionAll(_blocked(large, BLOCK)) if large else small).distinct(), "jaccard-apart")
    more = durable(_verified(apart, sets), "jaccard-links")
    found = components(near.unionAll(more))
    discard(probes, stars, sets, members, apart, near, more, *([large] if large else []))
    return sized, found


def join_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest doc_id it is linked to over any number of links."""
    docs = docs.select("doc_id", "text")
    sized, roots = links(docs)
    rooted = sized.groupBy("set").agg(F.min("doc_id").alias("first")).join(roots.withColumnRenamed("u", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("set", "component_id")
    out = sized.join(named.filter("set <> -1"), "set", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean()
        for b in batches:
            yield pd.DataFrame({"doc_id": None, "n_shingles": [len(s) for s in shingle_sets(b["text"].to_list())], "component_id": None})

    return out.unionAll(docs.filter("doc_id is null").mapInPandas(counted, "doc_id long, n_shingles long, component_id long"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that come first (by doc_id) in their component, with all columns."""
    first = join_documents(docs).filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi")
    return kept.unionAll(docs.filter("doc_id is null").select(*kept.columns))
