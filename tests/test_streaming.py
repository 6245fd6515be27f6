"""Streamed closed bins equal the batch twin, and late rows stay out."""

from pyspark.sql import functions as F

from binweave.streaming.closed_bins import closed, closed_bins, monitored, once_per_bin, run_available

SCHEMA = "route string, ts timestamp, value double"


def write(spark, rows, path):
    spark.createDataFrame([(r, t, v) for r, t, v in rows], "route string, t long, value double").select("route", F.timestamp_seconds("t").alias("ts"), "value").coalesce(1).write.mode("append").parquet(path)


def test_closed_bins(spark, tmp_path):
    path, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    first = [("a", 600 * i + 60 * j, float(i + j)) for i in range(6) for j in range(3)]
    write(spark, first, path)
    q = run_available(closed_bins(spark.readStream.schema(SCHEMA).parquet(path)), out, check)
    q.awaitTermination()
    batch = closed(spark.read.parquet(path), max(t for _, t, _ in first)).select("route", "bin", "y", "n")
    got = spark.read.parquet(out)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in batch.collect()} and got.count() == 5
    write(spark, [("a", 30, 99.0), ("a", 600 * 8, 1.0)], path)  # one late, one that closes bin 5
    run_available(closed_bins(spark.readStream.schema(SCHEMA).parquet(path)), out, check).awaitTermination()
    rows = {r.bin: r.y for r in spark.read.parquet(out).collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4, 5] and rows[0] == 1.0


def test_once_and_monitor(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, [("a", 600, 1.0), ("a", 600, 2.0), ("b", 1200, 3.0)], path)
    s = spark.readStream.schema(SCHEMA).parquet(path)
    run_available(once_per_bin(s, ["route", "ts"]), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
    f = spark.readStream.schema(SCHEMA).parquet(path).select("route", F.col("ts").alias("target_ts"), F.col("value").alias("forecast"))
    a = spark.readStream.schema(SCHEMA).parquet(path).select("route", F.col("ts").alias("bin_ts"), F.col("value").alias("y"))
    run_available(monitored(f, a), str(tmp_path / "m"), str(tmp_path / "mc")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "m")).filter("route = 'b'").first().actual == 3.0


def test_running_state_equals_batch(spark, tmp_path):
    """Gap, after_gap and the slew-limited value of a stream in three batches are those of the whole series; a bin that comes again is no news."""
    from binweave.operators import bins, shaping
    from binweave.streaming.state import with_running_state

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("a", b, float((b * 37) % 50)) for b in (1, 2, 3, 9, 10, 11, 12, 13, 14, 15, 16, 17, 30)] + [("b", b, float(b)) for b in (5, 6, 40)]
    path, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    try:
        for part in (rows[:4], rows[4:9] + [rows[13]], rows[9:13] + rows[14:] + [("a", 12, 999.0)]):
            spark.createDataFrame(part, "route string, bin long, y double").coalesce(1).write.mode("append").parquet(path)
            stream = spark.readStream.schema("route string, bin long, y double").parquet(path)
            run_available(with_running_state(stream), out, check).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    batch = spark.createDataFrame(rows, "route string, bin long, y double")
    want = shaping.slew_limited(bins.with_after_gap(bins.with_gap(batch)), 10.0)
    key = lambda df: sorted((r.route, r.bin, r.y, r.gap_min, r.after_gap, r.limited) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(want)


def test_live_cycle_writes_a_retried_batch_once(spark, tmp_path):
    from binweave.streaming.closed_bins import live_cycle

    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, [("a", 600, 1.0)], path)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(path)
    for check in ("c1", "c2"):  # a second query starts from batch 0 again, as after a lost commit
        live_cycle(stream(), lambda b: b.select("route", "value"), out, str(tmp_path / check)).awaitTermination()
    assert spark.read.parquet(out).count() == 1


def test_monitor_waits_for_the_label(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, [("a", 600, 1.0), ("b", 1200, 3.0)], path)
    s = spark.readStream.schema(SCHEMA).parquet(path)
    f = s.select("route", F.col("ts").alias("target_ts"), F.col("value").alias("forecast"))
    late = F.when(F.col("route") == "a", F.expr("interval 12 minutes")).otherwise(F.expr("interval 3 hours"))
    a = spark.readStream.schema(SCHEMA).parquet(path).select("route", F.col("ts").alias("bin_ts"), F.col("value").alias("y"), (F.col("ts") + late).alias("observed_ts"))
    run_available(monitored(f, a), str(tmp_path / "m"), str(tmp_path / "mc")).awaitTermination()
    assert [r.route for r in spark.read.parquet(str(tmp_path / "m")).collect()] == ["a"]
