"""Hot signatures of the Jaccard join: blocks find what whole groups find, and stay bounded."""

import random

import pytest

pytest.importorskip("binweave.llm")

from binweave.llm import jaccard  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def boiler(rng, n, shared, own):
    """Texts that share many words and are no near copies, but for some edits of them."""
    common = [f"w{i}" for i in range(shared)]
    out = []
    for i in range(n):
        words = common + [f"u{rng.randrange(10**9)}" for _ in range(own)]
        out.append(" ".join(words))
        if i % 5 == 0:  # a near copy
            words[rng.randrange(len(words))] = "edit"
            out.append(" ".join(words))
        if i % 11 == 0:  # a longer one that is still like it
            out.append(" ".join(words + [f"more{rng.randrange(10**6)}" for _ in range(len(words) // 6)]))
    return out


def sets(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components(texts):
    own, root = [sets(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(own)):
        for j in range(i):
            both = len(own[i] & own[j])
            if 100 * both >= 75 * (len(own[i]) + len(own[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(own))]


@pytest.mark.parametrize("shape", [(60, 30, 12), (40, 100, 40), (50, 12, 6)])
def test_blocks_find_what_all_pairs_find(spark, monkeypatch, shape):
    texts = boiler(random.Random(sum(shape)), *shape)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    got = {r.doc_id: r.component_id for r in jaccard.join_documents(df).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts)


def test_no_task_sees_more_than_two_blocks(spark):
    rng = random.Random(9)
    rows = [(1, i, i % 3 == 0, i, rng.choice([90, 100, 101, 130, 200]), jaccard.parity(jaccard.shingle_sets([f"{i} a b c d e"]).__next__())) for i in range(3000)]
    df = spark.createDataFrame(rows, "sig long, `set` long, ask boolean, root long, n long, bits binary").repartition(4)
    seen = []
    real = jaccard._facing

    def sized(pdf):
        import pandas as pd

        return pd.DataFrame({"u": [len(pdf)], "v": [int(pdf["side"].nunique())]})

    try:
        jaccard._facing = sized
        seen = jaccard._blocked(df, 100).collect()
    finally:
        jaccard._facing = real
    assert len(seen) > 50 and max(r.u for r in seen) < 2 * 100 * 1.6


def test_facing_blocks_give_what_whole_groups_give(spark):
    rng = random.Random(4)
    texts = boiler(rng, 40, 25, 6)
    own = list(jaccard.shingle_sets(texts))
    rows = [(7, i, rng.random() < 0.5, rng.randrange(6), len(s), jaccard.parity(s)) for i, s in enumerate(own)]
    df = spark.createDataFrame(rows, "sig long, `set` long, ask boolean, root long, n long, bits binary")
    whole = {(r.u, r.v) for r in df.repartition(1).sortWithinPartitions("sig", F.desc("ask")).mapInPandas(jaccard._apart, "u long, v long").collect()}
    assert whole and {(r.u, r.v) for r in jaccard._blocked(df, 7).collect()} == whole
