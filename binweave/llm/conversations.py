"""Repair of conversation structure: the cheapest edits that make roles alternate.

A conversation's rows, in the order of their turns, become the layers of a graph with four
states: nothing yet, after the system turn, after a user turn, after an assistant turn. Arcs
keep, rerole or delete a row, or insert an empty turn; what is left must read
(s?(ua)+)? in role initials. Forward and backward minimum costs mark the arcs that lie on a
cheapest path; from the start, the frontier of reached states takes the least edit letter
that any of its marked arcs has, step by step, which gives the least of all cheapest audits.

Two passes, both streams over rows dealt by conversation and sorted by turn: the first sees
of a row its role's initial, its faults and a digest, and finds the audit; the second
replays the audit over the texts into a running hash. A task holds of one conversation some
bytes a row, never its texts. Conversations that repeat, however often, are dealt apart.

Defined results: null roles and texts are one space, as are null ids and turns in a damage
key; rows of a null conv_id are one conversation. Equal turns: by role, then by the text's
MD5. A role's initial is its first character; an empty role has none and can't be kept, and
makes its neighbours illegal. Rows that repeat an earlier role and text are duplicates,
whatever their turn. A conversation without rows has no edits, zeros, and the hash of the
empty string. An empty table gives no rows; extra columns are ignored, whatever their names;
very long texts are read whole.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, narrow_batches

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
NONE = 1 << 50
#: States: nothing yet, system, user, assistant; which a role's initial may follow, and what role comes next.
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
SEEN = r"[^\x20\x09-\x0D]"


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage, and one row with present = false for each that was dropped: conv_id, turn, role, text, present."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), copies.alias("copy")).drop("copy")


def plan(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """rows (role initial, must go, cut off) -> least cost and the least of the cheapest audits."""
    n = len(rows)
    ahead, back = array("q", [NONE]) * (4 * n + 4), array("q", [NONE]) * (4 * n + 4)

    def arcs(i: int, q: int) -> Iterator[tuple[str, int, int]]:
        """Of row i from state q: (letter, cost, state after), letters ascending but for the insert."""
        initial, gone, cut = rows[i]
        yield "D", DELETE, q
        if not gone:
            extra = CUT_OFF if cut else 0
            if (to := KEPT.get((initial, q))) is not None:
                yield "K", KEEP + extra, to
            yield "R", REROLE + extra, NEXT[q]

    ahead[START] = 0
    for i in range(n + 1):
        at = 4 * i
        for _ in range(2):  # of inserts in a row only two can help
            for q in range(4):
                ahead[at + NEXT[q]] = min(ahead[at + NEXT[q]], ahead[at + q] + INSERT)
        if i < n:
            for q in range(4):
                if ahead[at + q] < NONE:
                    for _, cost, to in arcs(i, q):
                        ahead[at + 4 + to] = min(ahead[at + 4 + to], ahead[at + q] + cost)
    back[4 * n + START] = back[4 * n + ASSISTANT] = 0
    for i in range(n, -1, -1):
        at = 4 * i
        if i < n:
            for q in range(4):
                back[at + q] = min(cost + back[at + 4 + to] for _, cost, to in arcs(i, q))
        for _ in range(2):
            for q in range(4):
                back[at + q] = min(back[at + q], INSERT + back[at + NEXT[q]])
    best, audit, i, frontier = back[START], [], 0, {START}
    while not (i == n and any(q in (START, ASSISTANT) and ahead[4 * n + q] == best for q in frontier)):
        steps: dict[str, set[int]] = {}
        for q in frontier:
            now = ahead[4 * i + q]
            if now + INSERT + back[4 * i + NEXT[q]] == best:
                steps.setdefault("I", set()).add(NEXT[q])
            if i < n:
                for letter, cost, to in arcs(i, q):
                    if now + cost + back[4 * i + 4 + to] == best:
                        steps.setdefault(letter, set()).add(to)
        letter = min(steps)
        frontier = steps[letter]
        audit.append(letter)
        i += letter != "I"
    return best, "".join(audit)


class _Conversation:
    """What the first pass keeps of one conversation."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, bool, bool]] = []
        self.seen: set[bytes] = set()
        self.low = self.high = self.turn = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: str | None, initial: str, digest: bytes, blank: bool, cut: bool) -> None:
        again = digest in self.seen
        self.seen.add(digest)
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au") or not (self.last and initial)
        self.last = initial
        if turn is not None and (n := int(turn)) != self.turn:  # rows come by turn
            self.low, self.high, self.turn, self.turns = n if self.low is None else self.low, n, n, self.turns + 1
        self.blank += blank
        self.duplicate += again and not blank
        cut = cut and not blank and not again
        self.truncated += cut
        self.rows.append((initial, blank or again, cut))

    def close(self, conv_id: str | None) -> tuple:
        cost, audit = plan(self.rows)
        return conv_id, self.high - self.low + 1 - self.turns if self.turns else 0, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


AUDITS = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _audit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [x.split()[0] for x in AUDITS.split(", ")]
    now, own, begun = None, _Conversation(), False
    for b in batches:
        out = []
        for conv_id, turn, initial, digest, blank, cut, present in b[["conv_id", "turn_text", "initial", "digest", "blank", "cut", "present"]].itertuples(index=False, name=None):
            conv_id, turn = (None if x is None or x != x else x for x in (conv_id, turn))
            if begun and conv_id != now:
                out.append(own.close(now))
                own = _Conversation()
            now, begun = conv_id, True
            if present:
                own.add(turn, initial, bytes(digest), blank, cut)
        if out:
            yield pd.DataFrame(out, columns=columns)
    if begun:
        yield pd.DataFrame([own.close(now)], columns=columns)


def _dealt(rows: DataFrame, *first: str) -> DataFrame:
    """A conversation's rows follow each other in one task, the null one's too."""
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *first, F.col("turn").asc_nulls_first(), "role", "md5")


def audits(rows: DataFrame) -> DataFrame:
    """rows as of damaged() -> AUDITS, one row per conversation."""
    role_text = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    last: Column = F.regexp_extract("text", rf"(?s)({SEEN})[\x20\x09-\x0D]*\z", 1)
    slim = rows.select(
        F.col("conv_id").cast("string").alias("conv_id"), "turn", F.col("turn").cast("string").alias("turn_text"), "role", F.md5("text").alias("md5"), F.substring("role", 1, 1).alias("initial"),
        F.unhex(F.md5(role_text)).alias("digest"), (~F.col("text").rlike(SEEN)).alias("blank"), (~last.isin(".", "!", "?")).alias("cut"), "present",
    )
    return _dealt(slim).mapInPandas(_audit, AUDITS)


REPAIRED = "conv_id string, role string, text string"


def _edited(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str | None, str | None, str]]:
    """(conversation, role, text) of every repaired row; role null marks a conversation's beginning."""
    audit, at, state = "", 0, START

    def inserted(conv_id: str | None) -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, NEXT[state]
            yield conv_id, ROLES[state], ""

    for b in batches:
        for conv_id, role, text, given in b[["conv_id", "role", "text", "audit"]].itertuples(index=False, name=None):
            conv_id = None if conv_id is None or conv_id != conv_id else conv_id
            if isinstance(given, str):
                audit, at, state = given, 0, START
                yield conv_id, None, ""
                yield from inserted(conv_id)
                continue
            letter, at = audit[at], at + 1
            if letter == "K":
                state = KEPT[role[:1], state]
                yield conv_id, role, text
            elif letter == "R":
                state = NEXT[state]
                yield conv_id, ROLES[state], text
            yield from inserted(conv_id)


def _merged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The audit ahead of its conversation's rows."""
    turns = rows.filter("present").select(F.col("conv_id").cast("string").alias("conv_id"), F.lit(1).alias("kind"), "turn", "role", F.md5("text").alias("md5"), "text", F.lit(None).cast("string").alias("audit"))
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("md5"), F.lit("").alias("text"), "audit")
    return _dealt(heads.unionByName(turns), "kind")


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, place (from 0), role, text."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, place = [], 0
        for conv_id, role, text in _edited(batches):
            if role is None:
                place = 0
                continue
            out.append((conv_id, place, role, text))
            place += 1
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=["conv_id", "place", "role", "text"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "place", "role", "text"])

    narrow_batches(rows.sparkSession)
    return _merged(rows, found).mapInPandas(apply, "conv_id string, place long, role string, text string").withColumn("conv_id", F.col("conv_id").cast("long"))


def repair(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row per conversation: its faults, the least cost, the audit and the hash of the repaired rows."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, now, own, first = [], None, None, True
        for conv_id, role, text in _edited(batches):
            if role is None:
                if own is not None:
                    out.append((now, own.hexdigest()))
                now, own, first = conv_id, hashlib.sha256(), True
                if len(out) >= 1000:
                    yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"])
                    out = []
                continue
            own.update(f"{'' if first else '\n'}{role}:{text}".encode())
            first = False
        if own is not None:
            yield pd.DataFrame([*out, (now, own.hexdigest())], columns=["conv_id", "repaired_sha256"])

    narrow_batches(conversations.sparkSession)
    rows = damaged(conversations) if rows is None else rows
    found = durable(audits(rows), "audits")
    hashes = _merged(rows, found.select("conv_id", "audit")).mapInPandas(digest, "conv_id string, repaired_sha256 string")
    both = found.alias("f").join(hashes.alias("h"), F.col("f.conv_id").eqNullSafe(F.col("h.conv_id")))
    return both.select(F.col("f.conv_id").cast("long").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
