"""Benchmarks of many blocks: several passes find and drop what one pass does."""

import random

import pytest

pytest.importorskip("binweave.llm")

from binweave.llm import decontaminate  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_many_groups_find_what_one_does(spark, monkeypatch):
    rng = random.Random(2)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = bench.collect()
    words = [w for r in items for w in r.text.split()]
    filler = lambda: " ".join(rng.choice(words) + str(rng.randrange(90)) for _ in range(60))
    planted = [(10**6 + k, f"{filler()} {r.text} {filler()}", "x") for k, r in enumerate(items)] + [(None, f"{filler()} {items[0].text}", None), (None, filler(), None)]
    both = docs.unionAll(spark.createDataFrame(planted, docs.schema)).repartition(4)
    key = lambda r: (r.doc_id is None, r.doc_id, r.item_id)
    one = sorted(map(key, decontaminate.find_leaks(both, bench).collect()))
    kept = sorted(str(r.doc_id) + str(r.text) for r in decontaminate.drop_leaks(both, bench).collect())
    monkeypatch.setattr(decontaminate, "GROUP", 1)
    monkeypatch.setattr(decontaminate, "RANK", 16)
    passes = []
    real = decontaminate._index
    monkeypatch.setattr(decontaminate, "_index", lambda *a, **n: passes.append(1) or real(*a, **n))
    many = sorted(map(key, decontaminate.find_leaks(both, bench).collect()))
    assert len(passes) >= 3
    planted_ids = {(False, 10**6 + k, r.item_id) for k, r in enumerate(items)}
    assert planted_ids <= set(one) and planted_ids <= set(many)
    assert {k[:2] for k in one} == {k[:2] for k in many}
    assert sorted(str(r.doc_id) + str(r.text) for r in decontaminate.drop_leaks(both, bench).collect()) == kept
    assert decontaminate.drop_leaks(both, bench).columns == both.columns
