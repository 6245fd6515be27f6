"""Words of texts as arrays: codes, anchored runs of passages, and hashes of passages.

A passage is `words` words (runs without white space, punctuation at their ends left off).
Its anchor is, of its first WINDOW words, the one whose GRAM words have the smallest hash
(the first such); passages of one anchor form a run, with a core, the words - WINDOW + 1
words from the anchor that all of them hold. Equal passages have equal anchors and cores.
Words and passages are compared as 64-bit hashes.
"""

from __future__ import annotations

import re

import numpy as np

from .jaccard import mix

#: Words of a passage (over 50).
WORDS = 51
WINDOW = 36
GRAM = 4
#: Words of more bytes are hashed one by one.
LONG = 64

_BYTES = np.arange(256)
_SPACE = np.isin(_BYTES, [*range(0x09, 0x0E), *range(0x1C, 0x21)])
_INNER = (_BYTES >= 0x80) | np.array([chr(c).isalnum() for c in _BYTES])
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_OTHER = re.compile(r"[^\w\x00-\x7f]")
#: Powers of _BASE and of its inverse, modulo 2 ** 64.
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(max(n, 1 << 20), base, np.uint64)
        x[0] = 1
        made.append(np.multiply.accumulate(x))
    if n <= 1 << 22:
        _POWERS[:] = made
    return made[0][:n], made[1][:n]


def shape(text: str, raw: bytes) -> bytes:
    """The text's bytes, with white space and punctuation beyond ASCII as as many ASCII ones."""
    if len(text) == len(raw) or not _OTHER.search(text):
        return raw
    return _OTHER.sub(lambda m: (" " if m[0].isspace() else "!") * len(m[0].encode("utf-8", "surrogatepass")), text).encode("utf-8")


def codes(texts: list[str], raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A code for each word of the texts, one after another, and each text's number of words."""
    from xxhash import xxh3_64_intdigest as digest

    shapes = [shape(t, r) for t, r in zip(texts, raws, strict=True)]
    joined = b" ".join(raws) + b" "
    data = np.frombuffer(joined, np.uint8)
    shaped = data if all(a is b for a, b in zip(shapes, raws, strict=True)) else np.frombuffer(b" ".join(shapes) + b" ", np.uint8)
    space = _SPACE[shaped]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    first, end = edge[::2].copy(), edge[1::2].copy()
    count = np.diff(np.searchsorted(first, np.cumsum([0, *(len(r) + 1 for r in raws)])))
    inner = _INNER[shaped]
    dressed = np.flatnonzero(~(inner[first] & inner[end - 1]))
    if len(dressed):
        places = np.flatnonzero(inner)
        a, b = np.searchsorted(places, first[dressed]), np.searchsorted(places, end[dressed])
        dressed, a, b = (x[a < b] for x in (dressed, a, b))
        first[dressed], end[dressed] = places[a], places[b - 1] + 1
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply(_VALUE[data], power, out=sums[1:])
    np.cumsum(sums, out=sums)
    out = mix((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64))
    for k in np.flatnonzero(end - first > LONG).tolist():
        out[k] = digest(joined[first[k] : end[k]])
    return out, count


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x += b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def hashes(code: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """For each of the lengths, ascending, the hash of that many words from every word on."""
    out, size = [], 1
    for n in lengths:
        while size * 2 <= n:
            code = _pair(code[:-size], code[size:])
            size *= 2
        out.append(_pair(code[: len(code) - (n - size)], code[n - size :]) if n > size else code)
    return out


def starts(count: np.ndarray, words: int) -> np.ndarray:
    """The words at which a passage of their text starts."""
    begin, own = np.cumsum(count) - count, np.maximum(0, count - words + 1)
    return np.arange(own.sum()) + np.repeat(begin - (np.cumsum(own) - own), own)


def anchors(code: np.ndarray, count: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """Of every run of passages: text number, anchor, first and last start (words of the text), hashes of core and run."""
    start = starts(count, words)
    if not len(start):
        return (*[np.zeros(0, np.int64)] * 4, *[np.zeros(0, np.uint64)] * 2)
    gram, core, passage = hashes(code, GRAM, words - WINDOW + 1, words)
    key = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        key = np.minimum(key[:-step], key[step:])
        width += step
    at = (key[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    first, last, at = start[new], start[np.concatenate([new[1:], [len(at)]]) - 1], at[new]
    ends = np.cumsum(count)
    text = np.searchsorted(ends, first, "right")
    begin = (ends - count)[text]
    run = _pair(_pair(passage[first], passage[last]), ((at - first) << 8 | (last - first)).astype(np.uint64))
    return text, at - begin, first - begin, last - begin, core[at], run


#: What is told of an anchor's passages: where they start, how many they are, and whether they are known to be repeated.
_HEAD = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("first", "<u4"), ("count", "<u2"), ("known", "u1")])


def block(head: np.ndarray, passage: np.ndarray) -> bytes:
    return len(head).to_bytes(4, "little") + head.tobytes() + passage.tobytes()


def told(doc: np.ndarray, tag: np.ndarray, first: np.ndarray, count: np.ndarray, known: np.ndarray) -> np.ndarray:
    head = np.zeros(len(doc), _HEAD)
    head["doc"], head["tag"], head["first"], head["count"], head["known"] = doc, tag, first, count, known
    return head


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, `count` of them."""
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


def repeated(blocks: list[bytes], across: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the passages not yet known, those that are repeated (across: in another document): doc, tag, first and last start."""
    heads, hashed = [], []
    for b in blocks:
        n = int.from_bytes(b[:4], "little")
        heads.append(np.frombuffer(b, _HEAD, n, 4))
        hashed.append(np.frombuffer(b, np.uint64, -1, 4 + n * _HEAD.itemsize))
    head, key = np.concatenate(heads), np.concatenate(hashed)
    count = head["count"].astype(np.int64)
    owner = np.repeat(np.arange(len(head)), count)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([new, [len(key)]]))
    met = np.repeat(size > 1, size)
    order, size = order[met], size[size > 1]
    if not len(order):
        return (np.zeros(0, np.int64),) * 4
    own, new = head[owner[order]], np.cumsum(size) - size
    if across:
        several = np.zeros(len(size), bool)
        for name in ("doc", "tag"):
            several |= np.minimum.reduceat(own[name], new) != np.maximum.reduceat(own[name], new)
        several |= np.maximum.reduceat(own["known"], new) > 0
        order, own = order[np.repeat(several, size)], own[np.repeat(several, size)]
    found = np.zeros(len(key), bool)
    found[order[own["known"] == 0]] = True
    at = np.flatnonzero(found)
    start = spread(head["first"].astype(np.int64), count)[at]
    owner = owner[at]
    joins = (owner[1:] == owner[:-1]) & (start[1:] == start[:-1] + 1)
    opens = np.flatnonzero(np.concatenate([[True], ~joins])) if len(at) else at
    closes = np.flatnonzero(np.concatenate([~joins, [True]])) if len(at) else at
    return head["doc"][owner[opens]], head["tag"][owner[opens]], start[opens], start[closes]
