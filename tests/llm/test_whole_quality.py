"""The whole quality query against a plain version: counts by loops, Gaussians by determinants, the hold-out by zlib."""

import math
import zlib

import numpy as np
import pytest

pytest.importorskip("binweave.llm")

SF = "/root/testdata/sf0.001"


def plain_statistics(text):
    text = text or ""
    raw = text.encode()
    words, lines = text.split(), [x for x in text.split("\n") if x]
    count = lambda chars: sum(raw.count(c.encode()) for c in chars)
    upper = sum(65 <= b <= 90 for b in raw)
    lower = sum(97 <= b <= 122 for b in raw)
    size, n = max(1, len(raw)), max(1, len(words))
    often = {}
    for w in words:
        often[w] = often.get(w, 0) + 1
    return [
        math.log1p(len(words)), math.log1p(len(text) / n), math.sqrt(upper / (upper + lower + 1)), math.sqrt(count("0123456789") / size), math.sqrt(count(".,;:?!'\"()-") / size),
        math.sqrt(count("#$%&*|<>{}[]=+_~^\\/@`") / size), math.sqrt(count("!") / size), math.sqrt(count("\n") / size), math.log((len(often) + 1) / (n + 1)),
        math.sqrt(sum(a == b for a, b in zip(words, words[1:], strict=False)) / n), math.sqrt(max(often.values(), default=0) / n), math.sqrt(sum(len(w) > 3 and w.isupper() for w in words) / n),
        math.sqrt(count("|") / size), math.sqrt(len(set(lines)) / max(1, len(lines))),
    ]


def plain_query(docs, labels, shrinkage=0.1, diagonal=0.05):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in docs}
    x = {i: np.array(plain_statistics(t)) for i, t in docs}
    groups = [np.array([x[i] for i, q in labels if q == k and i in x and not held[i]]) for k in (0, 1)]
    total = sum(map(len, groups))
    pooled = sum(np.cov(g.T, bias=True) * len(g) for g in groups) / total
    out = []
    for i, _ in docs:
        logs = []
        for g in groups:
            c = (1 - shrinkage) * np.cov(g.T, bias=True) + shrinkage * pooled
            c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + 1e-6 * np.eye(len(c))
            e = x[i] - g.mean(axis=0)
            logs.append(math.log(len(g) / total) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * float(e @ np.linalg.solve(c, e)))
        score = 1 / (1 + math.exp(min(500.0, max(-500.0, logs[0] - logs[1]))))
        out.append((i, held[i], score, int(score >= 0.3)))
    return sorted(out)


def test_quality_query_is_the_plain_version(spark):
    from binweave.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    got = sorted((r.doc_id, r.held_out, r.score, r.predicted) for r in QUERIES["op7_quality"](spark, SF).collect())
    want = plain_query(docs, labels)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-6)
    assert all(g[3] == w[3] for g, w in zip(got, want, strict=True) if abs(w[2] - 0.3) > 1e-6)


def test_statistics_are_the_plain_counts():
    from binweave.llm.quality import statistics

    for text in (None, "", " \n\t", "A B! ABCD WORD word word\n\nline|line\nline|line", "é ÀÉ 日本語 😀" * 50, "x" * 10_000, "1,2;3 <a>{b}"):
        assert np.allclose(statistics(text), plain_statistics(text)), text


def test_every_operator_and_the_pipeline_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1, n
    assert "pipeline" in names
