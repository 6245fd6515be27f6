"""Chat formatting as a prefix tree: initial turns that conversations share are emitted once.

Template: a turn is <|role|>, a line feed, the text, </s> and a line feed. Control strings
inside texts get a backslash after their first character (one more, if some stand there
already), which unescaping takes away again; roles are escaped so that they hold neither a
bar nor a line feed. The three pieces are tokenised apart, so that the loss mask, which is
the text of assistant turns, begins and ends between tokens.

Tree: conversations are sorted by the digests of their turns. Neighbours in that order share
the longest prefix, so that a conversation emits the turns which its predecessor lacks, and
the order of emission is depth-first. A turn's place is a running sum of tokens: each range
of the sorted conversations sums its own, and the ranges' ends (two conversations' digests
and lengths for each range, never texts) meet in the driver, which says where each range
begins and where the turns stand that its first conversation shares with the range before.
A tree is what begins with one first turn; it may lie in many ranges.

Output, two tables. Nodes: tree (the place of its first token), start, tokens, position
(position id of the first token; the others count on), spans (the intervals of earlier tokens
it may attend to, its ancestors' and no others), ids, loss_first and loss_last (the masked
tokens, counted from start), and the range, row and depth that order them. Members: for each
conversation where its turns stand.

Reading back streams the nodes of a range in order and keeps a running hash for each turn of
the path it is on, so that a shared prefix is decoded and hashed once in a range.

Defined results: null texts and roles are empty; equal turns of one conversation go by role,
then text; null ids are one conversation; repeated conversations are members of the same
path, repeated rows turns of their own; an empty table gives the added conversation alone, or
nothing; columns other than conv_id, turn, role and text are ignored, whatever their names;
very long texts are tokenised whole. A conversation's digests are one value, 16 bytes a turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, durable, narrow_batches, parts, whole

#: What may not stand in a text as it is: the template's own marks, those of other templates, and special tokens.
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"
ADDED = "</s>[INST] ok [/INST]"
TURN = re.compile(r"<\|([^|\n]*)\|>\n(.*)</s>\n", re.DOTALL)
HEAD = 16
_ROLE = {"\\": "\\\\", "|": "\\!", "\n": "\\n"}
_UNROLE = {"\\\\": "\\", "\\!": "|", "\\n": "\n"}


def escaped(text: str) -> str:
    return re.sub(CONTROL, r"\1\\\2\3", text)


def unescaped(text: str) -> str:
    return re.sub(ESCAPED, r"\1\2\3", text)


def escaped_role(role: str) -> str:
    return re.sub(r"[\\|\n]", lambda m: _ROLE[m[0]], role)


def unescaped_role(role: str) -> str:
    return re.sub(r"\\[\\!n]", lambda m: _UNROLE[m[0]], role)


def pieces(role: str, text: str) -> tuple[str, str, str]:
    """A turn as the template has it: head, text, end."""
    return f"<|{escaped_role(role)}|>\n", escaped(text), "</s>\n"


def with_added(conversations: DataFrame) -> DataFrame:
    """The conversations plus conversation -1, whose texts are control strings."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    own = rows.sparkSession.createDataFrame([(-1, 0, "user", ADDED), (-1, 1, "assistant", ADDED)], "conv_id long, turn long, role string, text string")
    return rows.unionByName(own)


def tokenised(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per turn: conv_id, depth (0, 1, ... by turn), digest, ids, tokens, loss_first, loss_last."""

    def encode_turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .packing import encoder

        encode = encoder(tokenizer_path)
        for b in batches:
            out = []
            for conv_id, depth, role, text, digest in b[["conv_id", "depth", "role", "text", "digest"]].itertuples(index=False, name=None):
                head, body, end = map(encode, pieces(role, text))
                first = len(head) // 4
                masked = (first, first + len(body) // 4) if role == "assistant" else (0, 0)
                ids = head + body + end
                out.append((conv_id, depth, digest, ids, len(ids) // 4, *masked))
            yield pd.DataFrame(out, columns=["conv_id", "depth", "digest", "ids", "tokens", "loss_first", "loss_last"])

    narrow_batches(conversations.sparkSession)
    turns = conversations.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", whole("role").alias("role"), whole("text").alias("text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)), 1, HEAD)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")) - 1
    rows = turns.withColumn("depth", place).withColumn("digest", digest)
    return rows.mapInPandas(encode_turns, "conv_id string, depth int, digest binary, ids binary, tokens int, loss_first int, loss_last int")


def _shared(a: bytes, b: bytes) -> int:
    """Turns at which two paths begin alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // HEAD
    low, high = 0, n // HEAD  # the first difference lies in turn low .. high
    while high - low > 1:
        mid = (low + high) // 2
        if a[: mid * HEAD] == b[: mid * HEAD]:
            low = mid
        else:
            high = mid
    return low


WALK = "part int, row long, conv_id string, shared int, counts array<int>, starts array<long>, first_path binary, last_path binary, total long"


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted conversations of one range -> their turns' places, counted from the range's begin; the last row has the range's ends."""
    columns = [x.split()[0] for x in WALK.split(", ")]
    part, row, at, before, path, first = TaskContext.get().partitionId(), 0, 0, b"", [], b""
    held: tuple | None = None
    for b in batches:
        out = []
        for conv_id, key, counts in zip(b["conv_id"], b["path"], b["counts"], strict=True):
            key, counts = bytes(key), [int(x) for x in counts]
            shared = _shared(before, key)
            path = path[:shared]
            for n in counts[shared:]:
                path.append(at)
                at += n
            if held:
                out.append((*held, None, None, None))
            first = first or key
            held, before, row = (part, row, conv_id, shared, counts, list(path)), key, row + 1
        if out:
            yield pd.DataFrame(out, columns=columns)
    if held:
        yield pd.DataFrame([(*held, first, before, at)], columns=columns)


def _placed(walk: DataFrame) -> tuple[list[tuple], list[tuple]]:
    """For each range (part, base, cut): a local place p is base + p, unless it is below cut; then it belongs to the range before, at the place that spine (part, depth, start) tells."""
    ends = sorted(walk.filter("total is not null").select("part", "first_path", "last_path", "total", "counts", "starts").collect(), key=lambda r: r["part"])
    ranges, spine, base, last, places, counts = [], [], 0, b"", [], []
    for r in ends:
        shared = _shared(last, bytes(r["first_path"]))
        cut = sum(counts[:shared])
        spine += [(r["part"], d, places[d]) for d in range(shared)]
        ranges.append((r["part"], base - cut, cut, shared))
        places = [places[d] if p < cut else base - cut + p for d, p in enumerate(r["starts"])]
        last, counts, base = bytes(r["last_path"]), r["counts"], base - cut + r["total"]
    return ranges, spine


def _merged_spans(starts: Column, counts: Column, depth: Column) -> Column:
    """The places of the first `depth` turns as intervals, neighbours joined."""
    own = F.slice(F.arrays_zip(starts.alias("first"), counts.alias("n")), F.lit(1), depth)
    one = lambda x: F.struct(x["first"].alias("first"), (x["first"] + x["n"]).alias("last"))
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")

    def join(acc: Column, x: Column) -> Column:
        end = F.element_at(acc, -1)
        longer = F.struct(end["first"].alias("first"), (x["first"] + x["n"]).alias("last"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["last"] == x["first"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(one(x))))

    return F.aggregate(own, none, join)


def format_tree(conversations: DataFrame, tokenizer_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, members, spine): the emitted turns, where each conversation's turns stand, and the turns that a range's first conversation shares with ranges before."""
    spark = conversations.sparkSession
    turns = durable(tokenised(conversations, tokenizer_path), "chat-turns")
    listed = F.sort_array(F.collect_list(F.struct("depth", "digest", "tokens")))
    paths = turns.groupBy("conv_id").agg(listed.alias("t")).select("conv_id", F.expr("aggregate(t, cast('' as binary), (a, x) -> concat(a, x.digest))").alias("path"), F.col("t.tokens").alias("counts"))
    dealt = paths.repartitionByRange(parts(spark), "path", "conv_id").sortWithinPartitions("path", F.col("conv_id").asc_nulls_first())
    walk = durable(dealt.mapInPandas(_walk, WALK), "chat-walk")
    ranges, spine = _placed(walk)
    heads = spark.createDataFrame(ranges, "part int, base long, cut long, inherited int")
    spine_rows = spark.createDataFrame(spine, "part int, depth int, start long")
    inherited = spine_rows.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("depth", "start"))).alias("s")).select("part", F.col("s.start").alias("before"))
    edges = F.broadcast(heads.join(inherited, "part", "left").withColumn("before", F.coalesce("before", F.array().cast("array<bigint>"))))  # one row per range
    members = walk.join(edges, "part").select(
        "part", "row", "conv_id", F.when(F.col("row") == 0, F.col("inherited")).otherwise(F.col("shared")).alias("shared"), "counts",
        F.transform("starts", lambda p, d: F.when(p < F.col("cut"), F.try_element_at("before", d + 1)).otherwise(F.col("base") + p)).alias("starts"),
    )
    members = durable(members.withColumn("tree", F.element_at("starts", 1)), "chat-members")
    own = members.filter(F.col("shared") < F.size("counts")).withColumn("spans", _merged_spans(F.col("starts"), F.col("counts"), F.col("shared"))).withColumnRenamed("conv_id", "owner")
    start = F.element_at("starts", F.col("depth") + 1)
    here = F.struct(F.element_at("starts", F.col("shared") + 1).alias("first"), start.alias("last"))
    ends = F.try_element_at("spans", F.lit(-1))
    grown = F.when(F.col("depth") == F.col("shared"), F.col("spans")).when(
        ends["last"] == here["first"], F.concat(F.slice("spans", 1, F.greatest(F.size("spans") - 1, F.lit(0))), F.array(F.struct(ends["first"].alias("first"), start.alias("last"))))
    ).otherwise(F.concat("spans", F.array(here)))
    position = F.aggregate(F.slice("counts", F.lit(1), F.col("depth")), F.lit(0).cast("long"), lambda a, n: a + n)
    joined = turns.join(own, turns.conv_id.eqNullSafe(own.owner) & (turns.depth >= own.shared))
    nodes = joined.select("tree", start.alias("start"), "tokens", position.alias("position"), grown.alias("spans"), "ids", "loss_first", "loss_last", "part", "row", "depth")
    nodes = durable(nodes, "chat-nodes")
    discard(turns, walk)
    return nodes, members, spine_rows


READ = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(nodes: DataFrame, members: DataFrame, spine: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per conversation, from the emitted ids alone: READ."""

    def decode_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .packing import decoder

        decode = decoder(tokenizer_path)
        columns, part, path = [x.split()[0] for x in READ.split(", ")], None, []
        for b in batches:
            out = []
            for own, depth, conv_id, raw, first, last in b[["part", "depth", "conv_id", "ids", "loss_first", "loss_last"]].itertuples(index=False, name=None):
                if own != part:
                    part, path = own, []
                turns, loss, loss_chars, chars = path[depth - 1] if depth else (hashlib.sha256(), hashlib.sha256(), 0, 0)
                if raw is None:  # a conversation ends here
                    out.append((conv_id, depth, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    continue
                raw = bytes(raw)
                head, masked, tail = decode(raw[: 4 * first]), decode(raw[4 * first : 4 * last]), decode(raw[4 * last :])
                shown = head + masked + tail
                found, masked = TURN.fullmatch(shown), unescaped(masked)
                turns, loss = turns.copy(), loss.copy()
                turns.update(f"{unescaped_role(found[1])}\n{unescaped(found[2])}\n".encode())
                loss.update(masked.encode())
                path[depth:] = [(turns, loss, loss_chars + len(masked), chars + len(shown))]
            if out:
                yield pd.DataFrame(out, columns=columns)

    narrow_batches(nodes.sparkSession)
    event = ["part", "row", "depth", "conv_id", "ids", "loss_first", "loss_last"]
    emitted = nodes.withColumn("conv_id", F.lit(None).cast("string"))
    earlier = emitted.drop("part", "row", "depth").join(spine.withColumn("row", F.lit(-1).cast("long")), "start").select(*event)
    leaves = members.select("part", "row", F.size("counts").alias("depth"), "conv_id", F.lit(None).cast("binary").alias("ids"), F.lit(0).alias("loss_first"), F.lit(0).alias("loss_last"))
    events = emitted.select(*event).unionByName(earlier).unionByName(leaves)
    return events.repartition("part").sortWithinPartitions("part", "row", "depth", F.col("ids").isNull()).mapInPandas(decode_paths, READ).withColumn("conv_id", F.col("conv_id").cast("long"))


def format_conversations(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """The conversations and the added one, formatted as a prefix tree and read back."""
    return read_back(*format_tree(with_added(conversations), tokenizer_path), tokenizer_path)
