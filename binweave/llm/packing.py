"""Harmonic packing of tokenised documents into fixed-length sequences.

A document is its token ids and the end-of-text id 1. Lengths fall into
reciprocal-capacity classes: class k holds pieces of which k fill a sequence, that
is, of at most capacity / k tokens. A class's open sequence closes when it has its
k pieces. A document's length is met by such pieces: whole sequences first, then
what remains either goes to class k as it is, if k of it leave at most SLACK
tokens unused, or gives off one piece of floor(capacity / (k + 1)) tokens and goes on.

Each worker fills its own sequences and needs no exchange. When it ends, the pieces
of classes that aren't full are joined and cut at full sequences; the last of them
is cut at powers of two, which need no padding.

Defined results: null and empty texts are the end id alone; repeated rows are
packed as often as they stand; null and repeated ids are packed like others; an empty
table gives no rows; other columns are ignored, whatever their names; very long texts
are tokenised whole and cut into whole sequences first. Ids are those of the library's
encode(text, add_special_tokens=False): the string of a special token gives its id.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow_batches

SCHEMA = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded long"
END = (1).to_bytes(4, "little")
SLACK = 32
#: Pieces are looked up here before the tokenizer is asked; the table is emptied at this many entries.
REMEMBERED = 400_000
_L = "A-Za-zÀ-ÖØ-öø-ɏ"
_S = " \t\n\x0b\x0c\r"
#: The vocabulary's split pattern over ASCII and Latin letters; other texts go to the tokenizer whole.
PLAIN = re.compile(rf"[\x00-\x7f{_L}]*")
SPLIT = re.compile(rf" ?[{_L}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^{_S}{_L}0-9]+|[{_S}]+(?![^{_S}])|[{_S}]+")


class _Pieces(dict):
    """Pre-token -> its ids as little-endian 32-bit bytes, by the byte-pair merges on a miss."""

    def __init__(self, merge: Callable[[bytes], list[int]]):
        super().__init__()
        self.merge = merge

    def __missing__(self, piece: str) -> bytes:
        out = as_bytes(self.merge(piece.encode()))
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = out
        return out


def as_bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else b"".join(i.to_bytes(4, "little") for i in ids)


def encoder(path: str) -> Callable[[str | None], bytes]:
    """A function from a text to its ids, as bytes: those of tokenizers with the vocabulary file at path.

    Plain texts are split here and their pieces merged by tiktoken over the same
    file's vocabulary, which is several times faster; the ids are the same.
    """
    import tiktoken
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    shown = pre_tokenizers.ByteLevel.alphabet()  # the characters that stand for the 256 bytes
    stands = {c: b for b, c in _byte_characters(shown)}
    ranks = {bytes(stands[c] for c in token): i for token, i in tokenizer.get_vocab(with_added_tokens=False).items() if all(c in stands for c in token)}
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    for t in added:
        ranks.pop(t.encode(), None)
    # a text that holds an added token's string goes to the library, which knows how it splits the rest
    extra = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
    pieces = _Pieces(tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece)

    def encode(text: str | None) -> bytes:
        if not text:
            return b""
        if (text.isascii() or PLAIN.fullmatch(text)) and not (extra and extra.search(text)):
            return b"".join(map(pieces.__getitem__, SPLIT.findall(text)))
        return as_bytes(tokenizer.encode(text, add_special_tokens=False).ids)

    return encode


def decoder(path: str) -> Callable[[bytes], str]:
    """The way back: a text from its ids, as bytes."""
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    stands = {c: b for b, c in _byte_characters(pre_tokenizers.ByteLevel.alphabet())}
    table = {i: bytes(stands[c] for c in token) for token, i in tokenizer.get_vocab(with_added_tokens=False).items() if all(c in stands for c in token)}
    table |= {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    return lambda raw: b"".join([table[i] for i in array("I", raw)]).decode()


def _byte_characters(shown: list[str]) -> list[tuple[int, str]]:
    """Byte-level vocabularies show printable bytes as themselves and the others, in order, as characters from 256 on."""
    own = {ord(c) for c in shown if ord(c) < 256}
    rest = iter(range(256, 512))
    return [(b, chr(b) if b in own else chr(next(rest))) for b in range(256)]


class Packer:
    """One worker's open sequences. put() and close() return finished pieces as rows of SCHEMA."""

    def __init__(self, worker: int, capacity: int):
        self.capacity, self.next_id = capacity, worker << 33
        self.open: dict[int, list[tuple]] = {}

    def _finish(self, pieces: list[tuple], padded: int) -> list[tuple]:
        rows, at = [], 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next_id, at, padded))
            at += n
        self.next_id += 1
        return rows

    def put(self, doc_id: str | None, ids: bytes) -> list[tuple]:
        total, at, rows = len(ids) // 4, 0, []
        while at < total:
            left = total - at
            k = self.capacity // left
            if k == 0:
                n = self.capacity
            elif self.capacity - k * left <= SLACK:
                n = left
            else:
                n = self.capacity // (k + 1)
            k = self.capacity // n
            held = self.open.setdefault(k, [])
            held.append((doc_id, at, ids[4 * at : 4 * (at + n)], total))
            at += n
            if len(held) == k:
                rows += self._finish(self.open.pop(k), self.capacity)
        return rows

    def close(self) -> list[tuple]:
        held = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left, rows, room, now = sum(len(p[2]) // 4 for p in held), [], 0, []

        def next_room() -> int:
            return self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1) if left else 0

        room = size = next_room()
        for doc_id, start, ids, total in held:
            while ids:
                n = min(room, len(ids) // 4)
                now.append((doc_id, start, ids[: 4 * n], total))
                ids, start, room, left = ids[4 * n :], start + n, room - n, left - n
                if room == 0:
                    rows += self._finish(now, size)
                    now, room = [], next_room()
                    size = room
        return rows


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document; see SCHEMA. One narrow pass, no shuffle."""
    narrow_batches(docs.sparkSession)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, packer = encoder(tokenizer_path), Packer(TaskContext.get().partitionId(), capacity)
        columns = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                rows += packer.put(doc_id, encode(text) + END)
            if rows:
                yield pd.DataFrame(rows, columns=columns)
        if rows := packer.close():
            yield pd.DataFrame(rows, columns=columns)

    # ids travel as strings, as pandas would round long ids where some are null
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(pack, SCHEMA).withColumn("doc_id", F.col("doc_id").cast("long"))
