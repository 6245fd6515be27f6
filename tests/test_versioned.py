"""Versioned tables: whole versions or none, two writers, guards after a lost race, time travel, expiry."""

import threading

import pytest

from binweave.sources.versioned import Conflict, Refused, VersionedTable


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"))


def rows(spark, *t):
    return spark.createDataFrame([(x, f"v{x}") for x in t], "t long, v string")


def values(df):
    return sorted(r.t for r in df.collect())


def test_versions_and_time_travel(spark, table):
    assert table.latest() == 0 and table.versions() == []
    table.create("t long, v string")
    assert table.create("t long, v string") == 1 and values(table.read()) == []
    table.append(rows(spark, 1, 2))
    table.append(rows(spark, 3).selectExpr("'x' as extra", "v", "t"), ["t", "v"])
    assert [values(table.read(v)) for v in table.versions()] == [[], [1, 2], [1, 2, 3]]
    table.replace(rows(spark, 9))
    table.promote(3)
    assert values(table.read()) == [1, 2, 3] and values(table.read(4)) == [9]
    assert [h["operation"] for h in table.history()] == ["create", "append", "append", "replace", "promote"]


def test_second_writer_of_one_version_loses(spark, table):
    table.append(rows(spark, 1))
    base = table.latest()
    other = VersionedTable(spark, table.root)
    table.replace(rows(spark, 2), expected=base)
    with pytest.raises(Conflict):
        other.replace(rows(spark, 3), expected=base)
    assert values(table.read()) == [2]


def test_parallel_appends_all_get_in_once(spark, table):
    table.create("t long, v string")
    failed = []

    def load(k):
        try:
            VersionedTable(spark, table.root).append(rows(spark, k), tries=50)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=load, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and values(table.read()) == list(range(6)) and table.latest() == 7


def test_guard_looks_again_after_a_lost_race(spark, table, monkeypatch):
    """Two loads of one range pass the check together; the one that loses the race is refused."""
    table.append(rows(spark, 1, 2))
    other, raced = VersionedTable(spark, table.root), []
    real = table._commit

    def commit(parent, *rest):
        if not raced:
            raced.append(other.append_guarded(rows(spark, 5, 6), "t"))
        return real(parent, *rest)

    monkeypatch.setattr(table, "_commit", commit)
    with pytest.raises(Refused):
        table.append_guarded(rows(spark, 6), "t")
    assert values(table.read()) == [1, 2, 5, 6]
    assert table.append_guarded(rows(spark, 8), "t") == table.latest()


def test_upsert_is_made_on_one_version(spark, table, monkeypatch):
    table.append(rows(spark, 1, 2))
    real = table.replace

    def late(df, *a, **named):
        VersionedTable(spark, table.root).append(rows(spark, 3))
        return real(df, *a, **named)

    monkeypatch.setattr(table, "replace", late)
    with pytest.raises(Conflict):
        table.upsert(spark.createDataFrame([(2, "new")], "t long, v string"), ["t"])
    monkeypatch.undo()
    table.upsert(spark.createDataFrame([(2, "new"), (4, "new")], "t long, v string"), ["t"])
    assert {(r.t, r.v) for r in table.read().collect()} == {(1, "v1"), (2, "new"), (3, "v3"), (4, "new")}


def test_uncommitted_data_is_not_seen_and_expires(spark, table):
    table.append(rows(spark, 1))
    lost = table._written(rows(spark, 99))  # a writer that crashed before its commit
    assert values(table.read()) == [1]
    table.replace(rows(spark, 2))
    table.append(rows(spark, 3))
    gone = table.expire(1)
    assert lost in gone and values(table.read()) == [2, 3] and len(table.versions()) == 1
    table.append(rows(spark, 4))
    assert values(table.read()) == [2, 3, 4]


def test_resumed_loads(spark, table):
    table.append_new(rows(spark, 1, 2), ["t"])
    table.append_new(rows(spark, 2, 3), ["t"])
    table.append_new(rows(spark, 2, 3), ["t"])
    assert values(table.read()) == [1, 2, 3]


def test_coco_categories_belong_to_their_file(spark, tmp_path):
    import json

    from binweave.sources import readers

    for k, names in enumerate((["a", "b"], ["b", "a"])):
        doc = {"images": [], "annotations": [{"image_id": k, "category_id": 0, "bbox": [1, 2, 4, 6]}], "categories": [{"id": i, "name": n} for i, n in enumerate(names)]}
        (tmp_path / f"{k}.json").write_text(json.dumps(doc))
    got = sorted((r.frame, r.cls, r.x, r.y) for r in readers.coco(spark, str(tmp_path)).collect())
    assert got == [(0, "a", 3.0, 5.0), (1, "b", 3.0, 5.0)]


def test_file_order_is_by_name(spark, tmp_path):
    from binweave.sources import readers

    for name, value in (("b.csv", 2.0), ("a.csv", 1.0), ("c.csv", 3.0)):
        (tmp_path / name).write_text(f"timestamp,station_id,value_mm\n2024-01-01T00:00:00Z,S,{value}\n")
    assert readers.readings(spark, str(tmp_path)).first().value_mm == 1.0
