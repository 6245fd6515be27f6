"""Conversation repair, prefix-tree formatting and importance resampling against brute force, SQL and round trips."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import pytest

pytest.importorskip("binweave.llm")

from binweave.llm import chat, conversations, oracles, resampling  # noqa: E402
from binweave.llm.packing import encoder  # noqa: E402
from binweave.llm.queries import tokenizer_path  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

CLASHING = "conv_id long, turn long, role string, text string, kind string, audit string, ids binary, part int, depth string, start string, present int, md5 string, initial string, digest string, `row` string, counts string"
CONTROLS = ["</s>[INST] ok [/INST]", "<|user|>\nx</s>\n", "<\\|im", "<\\\\/s>", "a<", "<s><s>", "[\\/INST]", "<|endoftext|>", "\\", "[[INST]"]


def awkward(rng):
    """Conversations with every awkward case: (conv_id, turn, role, text)."""
    rows = []
    for c in range(60):
        opening = rng.choice(["Hello there.", "Shared start?", None])
        for t in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = opening if t == 0 else rng.choice(["Yes.", "No", "", None, " \t\n", "End!  \n", "Ünï 日本語 😀.", "Yes.", *CONTROLS])
            rows.append((c if rng.random() < 0.95 else None, rng.choice([t, t, t, None, 3]), role, text))
    rows += [(500 + c, t, r, x) for c in range(40) for t, (r, x) in enumerate([("system", "Be brief."), ("user", "Copy?"), ("assistant", "Copy.")])]
    rows += [(900, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(400)] + [(901, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(300)]
    rows += [(-5, 0, "user|>\nx\\n", "odd role."), (2**62, 0, "assistant", "word " * 40_000), (902, None, "user", "a."), (902, None, "user", "a.")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward(random.Random(11))


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, "k", "a", b"i", 1, "d", "s", 2, "m", "n", "g", "r", "c") for r in rows], CLASHING).repartition(5).cache()


def by_sql(rows, sql, schema="conv_id bigint, turn bigint, role varchar, text varchar", name="conversations"):
    con = duckdb.connect()
    con.sql(f"create table {name} ({schema})")
    con.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
    rel = con.sql(sql)
    return sorted(({c: v for c, v in zip(rel.columns, r, strict=True)} for r in rel.fetchall()), key=str)


def collected(df, columns):
    return sorted(({c: r[c] for c in columns} for r in df.collect()), key=str)


def brute_audit(rows):
    """All edit strings with up to two inserts in a row, the cheapest and least that reads (s?(ua)+)?."""
    found = []

    def walk(i, roles, cost, audit, inserts):
        if cost > 2 * len(rows):
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            found.append((cost, audit))
        if inserts < 2:
            for r in "ua":
                walk(i, roles + r, cost + 5, audit + "I", inserts + 1)
        if i < len(rows):
            initial, gone, cut = rows[i]
            walk(i + 1, roles, cost + 2, audit + "D", 0)
            if not gone:
                if initial:
                    walk(i + 1, roles + initial, cost + 5 * cut, audit + "K", 0)
                for r in "ua":
                    walk(i + 1, roles + r, cost + 1 + 5 * cut, audit + "R", 0)

    walk(0, "", 0, "", 0)
    return min(found)


def test_plan_is_the_cheapest_and_least_of_all_edits():
    options = [(initial, gone, cut) for initial in ("s", "u", "a", "t", "") for gone, cut in ((False, False), (False, True), (True, False))]
    for n in range(3):
        for rows in itertools.product(options, repeat=n):
            assert conversations.plan(list(rows)) == brute_audit(rows), rows
    rng = random.Random(3)
    for _ in range(60):
        rows = [rng.choice(options[:9]) if rng.random() < 0.8 else rng.choice(options) for _ in range(rng.randrange(3, 6))]
        assert conversations.plan(rows) == brute_audit(rows), rows


def test_repair_matches_sql(rows, table):
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert collected(conversations.repair(table), columns) == [{c: r[c] for c in columns} for r in by_sql(rows, oracles.repair())]


def test_repaired_rows_hash_as_repaired_and_alternate(table):
    damaged = conversations.damaged(table)
    found = conversations.audits(damaged)
    own = {}
    for r in conversations.repaired_rows(damaged, found).collect():
        own.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    for r in conversations.repair(table).collect():
        turns = sorted(own.get(r.conv_id, []))
        assert [t[0] for t in turns] == list(range(len(turns)))
        assert re.fullmatch(r"(s?(ua)+)?", "".join(t[1][0] for t in turns))
        assert hashlib.sha256("\n".join(f"{a}:{b}" for _, a, b in turns).encode()).hexdigest() == r.repaired_sha256


def test_repair_of_no_rows(spark):
    assert conversations.repair(spark.createDataFrame([], CLASHING)).collect() == []


def test_escapes_are_reversible():
    rng = random.Random(1)
    marks = ["<", "[", "\\", "|", "/s>", "s>", "INST]", "/INST]", "a", "\n", ">", "</s>", "<|", "<\\|"]
    for _ in range(20_000):
        text = "".join(rng.choice(marks) for _ in range(rng.randrange(9)))
        safe = chat.escaped(text)
        assert chat.unescaped(safe) == text
        assert not any(m in safe for m in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))
        assert chat.unescaped_role(chat.escaped_role(text)) == text
        head, body, end = chat.pieces(text, text)
        found = chat.TURN.fullmatch(head + body + end)
        assert (chat.unescaped_role(found[1]), chat.unescaped(found[2])) == (text, text)


def test_chat_reads_back_what_it_formatted(rows, table):
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert collected(chat.format_conversations(table, tokenizer_path()), columns) == [{c: r[c] for c in columns} for r in by_sql(rows, oracles.chats())]


def test_tree_emits_shared_turns_once_and_attends_to_ancestors(spark, rows, table):
    nodes, members, _ = chat.format_tree(table, tokenizer_path())
    at = {n.start: n for n in nodes.collect()}
    ends = sorted((n.start, n.start + n.tokens) for n in at.values())
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))  # gapless, nothing twice
    paths, encode = {}, encoder(tokenizer_path())
    for conv_id, turn, role, text in rows:
        paths.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(own)] for c, own in paths.items()}
    prefixes = {tuple(own[: k + 1]) for own in turns.values() for k in range(len(own))}
    assert len(at) == len(prefixes)
    stands = {}
    for m in members.collect():
        own = turns[None if m.conv_id is None else int(m.conv_id)]
        assert len(m.starts) == len(own) and m.tree == m.starts[0]
        seen = []
        for k, start in enumerate(m.starts):
            assert stands.setdefault(tuple(own[: k + 1]), start) == start
            node, pieces = at[start], [encode(p) for p in chat.pieces(*own[k])]
            assert bytes(node.ids) == b"".join(pieces) and node.tokens == len(node.ids) // 4 and node.tree == m.starts[0]
            assert node.position == sum(at[s].tokens for s in m.starts[:k])
            masked = (len(pieces[0]) // 4, (len(pieces[0]) + len(pieces[1])) // 4) if own[k][0] == "assistant" else (0, 0)
            assert (node.loss_first, node.loss_last) == masked
            assert [i for a, b in node.spans for i in range(a, b)] == [i for s in seen for i in range(s, s + at[s].tokens)]
            assert all(a[1] < b[0] for a, b in zip(node.spans, node.spans[1:], strict=False))  # neighbours joined
            seen.append(start)
    assert len(members.select("part").distinct().collect()) > 1  # ranges that begin on a shared path are among them


def test_chat_of_no_rows(spark):
    empty = spark.createDataFrame([], CLASHING)
    assert [r.conv_id for r in chat.format_conversations(empty, tokenizer_path()).collect()] == [-1]
    nodes, members, spine = chat.format_tree(empty, tokenizer_path())
    assert nodes.collect() == [] and chat.read_back(nodes, members, spine, tokenizer_path()).collect() == []


DOCS = "doc_id long, text string, rank long, score double, own string, words string, above string"
RESAMPLED = ["doc_id", "n_features", "weight", "score", "rank"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    words = ["Stone", "river", "ünder", "42", "Östlich", "日本", "x" * 3000, "a-b", "c_d", "\x7f", "É"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += [None, "", " \n", "...", texts[3], texts[3], "river stone " * 10_000] + ["same text again " * 10] * 60
    docs = [(i * 10**11, t) for i, t in enumerate(texts)] + [(None, "a row without an id " * 5), (0, texts[0]), (0, texts[0])]
    return docs, [(1, "Stone river 42 stone"), (2, None), (3, "日本 östlich")]


def brute_resample(docs, target, percent, grams, buckets, least=20):
    def features(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(own), [zlib.crc32(" ".join(own[i : i + n]).encode()) % buckets for n in range(1, grams + 1) for i in range(len(own) - n + 1)]

    seen = [features(t) for _, t in docs]
    s, t = ([b for own in each for b in own] for each in ([f[1] for f in seen], [features(x)[1] for _, x in target]))
    in_s, in_t = collections.Counter(s), collections.Counter(t)
    gain = [math.floor(1000 * math.log((in_t[b] + 1) * (len(s) + buckets) / ((in_s[b] + 1) * (len(t) + buckets)))) for b in range(buckets)]
    rows = []
    for (doc_id, _), (n_words, own) in zip(docs, seen, strict=True):
        weight = math.floor(sum(gain[b] for b in own) / len(own)) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    ranked = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(ranked):
        r.append(k + 1 if k < percent * len(ranked) // 100 else None)
    return sorted(str((*r[:4], r[5] if len(r) > 5 else None)) for r in rows)


@pytest.mark.parametrize(("grams", "buckets", "percent"), [(1, 500, 10), (2, 97, 50), (1, 50, 100), (3, 50, 0)])
def test_resampling_matches_brute_force(spark, corpus, grams, buckets, percent):
    docs, target = corpus
    table = spark.createDataFrame([(*d, 5, 0.5, "o", "w", "a") for d in docs], DOCS).repartition(4)
    goal = spark.createDataFrame([(*t, "x") for t in target], "item_id long, text string, bucket string")
    got = resampling.resample(table, goal, percent, grams=grams, buckets=buckets)
    assert got.columns == RESAMPLED
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_resample(docs, target, percent, grams, buckets)


def test_resampling_matches_sql(spark, corpus):
    docs, target = corpus
    con = duckdb.connect()
    for name, rows in (("documents", docs), ("benchmark", target)):
        con.sql(f"create table {name} ({'doc_id' if name == 'documents' else 'item_id'} bigint, text varchar)")
        con.executemany(f"insert into {name} values (?, ?)", rows)
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(target, "item_id long, text string"))
    rel = con.sql(oracles.resampling())
    assert rel.columns == RESAMPLED
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rel.fetchall()))


def test_resampling_of_empty_tables(spark, corpus):
    docs = spark.createDataFrame([], DOCS)
    goal = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(docs, goal).collect() == []
    some = spark.createDataFrame(corpus[0], "doc_id long, text string")
    assert {r.weight <= 0 for r in resampling.resample(some, goal).collect()} == {True}
    assert resampling.resample(docs, some).count() == 0
    assert resampling.resample(some, goal).filter(F.col("rank").isNotNull()).count() == brute_drawn(corpus[0])


def brute_drawn(docs):
    return sum(len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")) >= 20 for _, t in docs) * 10 // 100
