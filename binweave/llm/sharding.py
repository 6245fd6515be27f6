"""Minimax contiguous sharding with DataFrame operations only.

Documents with equal texts form an atomic group. Groups are put in the order of
their SHA-256, and the ordered group sizes are cut into `shards` contiguous runs
whose largest total is as small as any contiguous cut allows: a binary search
over the capacity with a greedy check.

The search sees the groups through ordered *cells*, ranges of a digest prefix
with total size, largest group and number of groups. A cell of several groups is
treated as divisible for a lower bound of the greedy cuts and as atomic for an
upper bound; only cells in which a cut may fall are split further by one Spark
job per round, so the driver holds a bounded number of cells whatever the input.

Defined results: null texts count as empty (size 1) and share the group of empty
texts; repeated rows each get a slot of their own; an empty table gives no rows;
additional columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, whole

#: Hex digits of the first cells, and digits added where a cell is split.
FIRST, MORE = 3, 2
#: Slots are counted within so many hash ranges of a shard.
RANGES = 1024


@dataclass(frozen=True)
class Cell:
    prefix: str
    size: int
    largest: int
    groups: int


def _cells(groups: DataFrame, digits: int, within: list[str] | None = None) -> list[Cell]:
    """Totals of the groups by digest prefix: of all groups, or of those in the given cells."""
    key = F.substring("digest", 1, digits)
    if within is not None:
        groups = groups.filter(F.substring("digest", 1, len(within[0])).isin(within))
    rows = groups.groupBy(key.alias("p")).agg(F.sum("bytes").alias("s"), F.max("bytes").alias("m"), F.count("*").alias("n")).collect()
    return [Cell(r.p, r.s, r.m, r.n) for r in rows]


def _greedy(cells: list[Cell], ends: list[int], capacity: int, shards: int, divisible: bool) -> list[int]:
    """Positions at which the greedy ends its shards, as bytes from the start: at most the true ones, or (divisible) at least."""
    at, cuts = 0, []
    for _ in range(shards):
        to = at + capacity
        i = bisect_right(ends, to)
        whole_cells = ends[i - 1] if i else 0
        if i == len(cells):
            at = ends[-1]
        elif cells[i].groups == 1:
            at = max(at, whole_cells)
        elif divisible:
            at = to
        else:
            at = max(at, whole_cells, min(to, to - cells[i].largest + 1))
        cuts.append(at)
    return cuts


def _least(cells: list[Cell], ends: list[int], shards: int, divisible: bool) -> int:
    """The smallest capacity with which the greedy reaches the end."""
    low, high = max(max(c.largest for c in cells), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        mid = (low + high) // 2
        if _greedy(cells, ends, mid, shards, divisible)[-1] >= ends[-1]:
            high = mid
        else:
            low = mid + 1
    return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """groups(digest hex, bytes) -> the smallest capacity, and the digest prefix at which each later shard begins."""
    digits = FIRST
    cells = sorted(_cells(groups, digits), key=lambda c: c.prefix)
    if not cells:
        return 0, []
    while True:
        ends, total = [], 0
        for c in cells:
            total += c.size
            ends.append(total)
        low, high = _least(cells, ends, shards, True), _least(cells, ends, shards, False)
        early, late = _greedy(cells, ends, low, shards, False), _greedy(cells, ends, high, shards, True)
        doubtful = {i for a, b in zip(early, late, strict=True) for i in range(bisect_right(ends, a), min(bisect_right(ends, b) + 1, len(cells))) if cells[i].groups > 1}
        if not doubtful:
            break
        by_digits: dict[int, list[int]] = {}
        for i in doubtful:
            by_digits.setdefault(len(cells[i].prefix), []).append(i)
        finer = [c for n, own in by_digits.items() for c in _cells(groups, n + MORE, [cells[i].prefix for i in own])]
        cells = sorted([c for i, c in enumerate(cells) if i not in doubtful] + finer, key=lambda c: c.prefix)
    starts = [bisect_right(ends, x) for x in _greedy(cells, ends, low, shards, False)]
    return low, [cells[i].prefix if i < len(cells) else "g" for i in starts[:-1]]


def shard_of(digest: Column, starts: list[str]) -> Column:
    """The number of later shards that begin at or before the digest."""
    out = F.lit(0)
    for s in starts:
        out = out + (digest >= F.lit(s)).cast("int")
    return out


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its size, checksum, shard and gapless slot there, under the law `bytes`."""
    text = whole(text_col).cast("binary")
    base = durable(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("digest")), "shard-sizes")
    _, starts = minimax_cuts(base.groupBy("digest").agg(F.sum("size").alias("bytes")), shards)
    put = base.withColumn("shard", shard_of(F.col("digest"), starts)).withColumn("range", F.pmod(F.xxhash64("doc_id"), F.lit(RANGES)).cast("int"))
    # at most shards * RANGES rows, whatever the input
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = put.groupBy("shard", "range").agg(F.count("*").alias("n")).select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("shard", "range").orderBy("doc_id", "digest")
    return (
        put.withColumn("at", F.row_number().over(own) - 1)
        .join(F.broadcast(offsets), ["shard", "range"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
