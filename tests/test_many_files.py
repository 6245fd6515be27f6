"""Files in numbers that grow with the input are written and read by the tasks; the driver knows their folders only."""

from pathlib import Path

import pytest

from binweave.plans import catalog
from binweave.sources import readers, sinks


def test_one_file_a_frame_without_listing_them(spark, tmp_path):
    """Before, the driver moved each frame's file and listed it: 1,500 input files here."""
    frames = 1500
    rows = spark.range(frames * 2).selectExpr("cast(floor(id / 2) * 50 as bigint) as l_orderkey", "'N' as l_returnflag", "id as l_partkey", "id as l_suppkey", "1 as l_linenumber")
    rows.unionByName(rows.filter("l_partkey = 7")).write.parquet(str(tmp_path / "lineitem.parquet"))
    out = catalog.queries()["s16_yolo"](spark, str(tmp_path))
    assert len(out.inputFiles()) < 100
    got = sorted(map(tuple, out.collect()))
    want = [(k // 2 * 50, "N", k % 40 * 1.0, k % 30 * 1.0, 11.0, 9.0) for k in [*range(frames * 2), 7]]
    assert got == sorted(want)


def test_coco_files_without_listing_them(spark, tmp_path):
    """Before, each file had a directory of its own that the driver moved and listed: 300 input files here."""
    rows = spark.range(600).selectExpr("cast(floor(id / 2) * 1000 as bigint) as l_orderkey", "'R' as l_returnflag", "id as l_partkey", "id as l_suppkey", "1 as l_linenumber")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    out = catalog.queries()["s16_coco"](spark, str(tmp_path))
    assert len(out.inputFiles()) < 100
    assert sorted(map(tuple, out.collect())) == sorted((k // 2 * 1000, "R", k % 40 * 1.0, k % 30 * 1.0, 11.0, 9.0) for k in range(600))


def test_text_files_in_folders(spark, tmp_path):
    texts = {f"{k}.txt": "2 0.5 0.25 0.1 0.2\r\n\n" * k + "é x" * (k % 2) for k in range(23)}
    root = f"file://{tmp_path}/files"
    folders = sinks.text_files(spark.createDataFrame(list(texts.items()), "name string, text string").repartition(2), root, per_folder=5)
    found = list(Path(tmp_path, "files").glob("part-*/*.txt"))
    assert {p.name: p.read_bytes().decode() for p in found} == texts and len(found) == 23
    assert folders.agg({"files": "max"}).first()[0] == 5 and folders.agg({"files": "sum"}).first()[0] == 23
    Path(tmp_path, "files", "part-000000-left-by-a-failed-attempt").mkdir()
    Path(tmp_path, "files", "part-000000-left-by-a-failed-attempt", "0.txt").write_text("none")
    files = readers.text_files(folders, root, at_once=10)
    assert {r.name: r.text for r in files.collect()} == texts
    boxes = readers.yolo_texts(files.filter("name = '2.txt'"), 100, 40)
    assert [tuple(r) for r in boxes.collect()] == [("2", "2", 50.0, 10.0, 10.0, 8.0)] * 2
    found[0].unlink()
    with pytest.raises(Exception, match="files"):
        readers.text_files(folders, root).collect()
    empty = sinks.text_files(spark.createDataFrame([], "name string, text string"), f"{root}-none")
    assert readers.text_files(empty, f"{root}-none").count() == 0
