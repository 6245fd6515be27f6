"""Queries that write given tables through the sinks and read them back through the readers; SQL says what must be there afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bins
from ..sources import readers, rest, runs, sinks
from ..sources.scratch import fresh
from ..sources.versioned import Refused, VersionedTable
from .catalog import register
from .series_queries import B10, GAPS, rounded, ten_minutes, with_gaps


def slim(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("event_type").alias("route"), bins.seconds("ts").alias("t"), "value")


_SLIM = "e as (select event_id, event_type as route, cast(floor(epoch(ts)) as bigint) as t, value from events)"


@register("k1_appended", f"with {_SLIM} select event_id, route, round(value,6) as value from e")
def k1(spark, d):
    """Four appends of a fixed projection; other columns stay out."""
    t = VersionedTable(spark, fresh(spark, "k1"))
    for k in range(4):
        t.append(slim(spark, d).filter(F.col("event_id") % 4 == k), ["event_id", "route", "value"])
    return rounded(t.read(), "value")


@register("k2_time_travel", f"with {_SLIM}, v(version, parts) as (values (1, 0), (2, 1), (3, 2), (4, 3)) select cast(version as bigint) as version, route, count(*) as n from v join e on event_id % 3 < parts group by 1, 2")
def k2(spark, d):
    """Every version of a table that was created empty and loaded in three parts, as it can still be read."""
    t = VersionedTable(spark, fresh(spark, "k2"))
    t.create("event_id long, route string")
    for k in range(3):
        t.append(slim(spark, d).filter(F.col("event_id") % 3 == k).select("event_id", "route"))
    out = None
    for v in t.versions():
        own = t.read(v).groupBy("route").agg(F.count("*").alias("n")).select(F.lit(v).cast("long").alias("version"), "route", "n")
        out = own if out is None else out.unionByName(own)
    return out


@register("k3_guarded", f"with {_SLIM}, s as (select *, cast(floor(t/604800) as bigint) as week from e) select week, count(*) as n, true as refused from s group by 1")
def k3(spark, d):
    """Loads of a week each, and each tried again: the second is refused, so that no week is there twice."""
    t = VersionedTable(spark, fresh(spark, "k3"))
    s = slim(spark, d).withColumn("week", F.floor(F.col("t") / 604800).cast("long"))
    span = s.agg(F.min("week").alias("a"), F.max("week").alias("b")).first()
    refused = []
    for week in range(span.a, span.b + 1):
        own = s.filter(F.col("week") == week)
        t.append_guarded(own, "t")
        try:
            t.append_guarded(own, "t")
        except Refused:
            refused.append(week)
    return t.read().groupBy("week").agg(F.count("*").alias("n")).withColumn("refused", F.col("week").isin(refused))


_CUST = "select c_custkey, case when c_custkey % 10 = 0 then 'new' else c_mktsegment end as seg from customer union all select c_custkey + 1000000, 'new' from customer where c_custkey % 100 = 0"


@register("k4_versioned_upsert", _CUST)
def k4(spark, d):
    """An upsert committed on the version that it was made from."""
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    t = VersionedTable(spark, fresh(spark, "k4"))
    t.append(c)
    t.upsert(c.filter("c_custkey % 10 = 0").select("c_custkey", F.lit("new").alias("seg")).union(c.filter("c_custkey % 100 = 0").select(F.col("c_custkey") + 1000000, F.lit("new"))), ["c_custkey"])
    return t.read()


@register("k6_keyed_csv", "select cast(n_nationkey as bigint) as key, case when n_nationkey % 3 = 0 then upper(n_name) || '!' else n_name end as name from nation union all select 1000 + n_nationkey, 'added' from nation where n_nationkey < 3")
def k6(spark, d):
    """A small keyed CSV file with rows replaced and added, written whole and renamed."""
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    path, schema = f"{fresh(spark, 'k6')}/nations.csv", "key long, name string"
    sinks.upsert_csv(n, path, ["key"], schema)
    more = n.filter("key % 3 = 0").select("key", F.concat(F.upper("name"), F.lit("!")).alias("name")).unionByName(n.filter("key < 3").select((F.col("key") + 1000).alias("key"), F.lit("added").alias("name")))
    sinks.upsert_csv(more, path, ["key"], schema)
    return readers.csv(spark, path, schema)


@register("k7_feature_table", f"with {GAPS} select route, bin, round(y,6) as y, after_gap from ag")
def k7(spark, d):
    """A feature table in Parquet, partitioned by series, replaced whole."""
    t = VersionedTable(spark, fresh(spark, "k7"))
    f = with_gaps(spark, d).select("route", "bin", "y", "after_gap")
    t.append(f.limit(10))
    t.replace(f, "route")
    return rounded(t.read(), "y")


@register("k8_resumed", f"with {_SLIM} select event_id, route, round(value,6) as value from e")
def k8(spark, d):
    """A load that broke off half way and is run again in overlapping pieces: every key gets in once."""
    t, s = VersionedTable(spark, fresh(spark, "k8")), slim(spark, d).select("event_id", "route", "value")
    for part in (F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0, F.lit(True), F.lit(True)):
        t.append_new(s.filter(part), ["event_id"])
    return rounded(t.read(), "value")


@register("k10_plot_series", f"with {B10} select route, bin, case when bin % 7 = 0 or bin % 11 = 0 or bin % 13 = 0 then null else round(y,6) end as y from bins")
def k10(spark, d):
    """A plot's CSV, in which NaN and infinities are empty."""
    path = fresh(spark, "k10")
    bad = F.when(F.col("bin") % 7 == 0, float("nan")).when(F.col("bin") % 11 == 0, float("inf")).when(F.col("bin") % 13 == 0, float("-inf"))
    sinks.plot_series(rounded(ten_minutes(spark, d), "y").withColumn("y", F.coalesce(bad, "y")), path, ["route", "bin", "y"])
    return readers.csv(spark, path, "route string, bin long, y double")


def _runs(spark, d) -> str:
    root, s = fresh(spark, "k11"), slim(spark, d)
    for version in (1, 2):
        own = s.filter(F.col("event_id") % version == 0)
        runs.write_run(spark, root, f"v{version}", {"metrics": own.groupBy("route").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")), "rows": own.select("event_id", "value")}, {"version": version})
    runs.promote(spark, root, "v2")
    return root


_RUN = f"with {_SLIM} select route, count(*) as n, round(avg(value),6) as mean from e where event_id % 2 = 0 group by 1"


@register("k11_promoted_run", _RUN)
def k11(spark, d):
    """Two runs with manifests; the second is validated, promoted and read by the pointer."""
    root = _runs(spark, d)
    folder = f"{root}/{runs.latest(spark, root)}"
    runs.validated(spark, folder)
    return spark.read.parquet(f"{folder}/metrics")


@register("k12_replayed", _RUN)
def k12(spark, d):
    """A figure's CSV replayed from the promoted run, without fitting anew."""
    root = _runs(spark, d)
    target = fresh(spark, "k12")
    runs.replay(spark, f"{root}/{runs.latest(spark, root)}", {"means": ("metrics", ["route", "n", "mean"])}, target, (f"{root}/v1",))
    return readers.csv(spark, f"{target}/means.csv", "route string, n long, mean double")


@register("k13_fingerprints", "select cast(n_nationkey as bigint) as key, sha256(n_name || chr(10)) as sha256 from nation")
def k13(spark, d):
    """SHA-256 of files, one for each nation."""
    path = fresh(spark, "k13")
    spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("key"), "n_name").write.partitionBy("key").text(path)
    return sinks.fingerprints(spark, path).select(F.regexp_extract("path", r"key=(\d+)", 1).cast("long").alias("key"), "sha256")


@register("s1_cached_scan", f"with {B10} select route, bin, round(y,6) as y from bins")
def s1(spark, d):
    """A pull that is kept: the second call reads the cache and loads nothing."""
    path, loads = fresh(spark, "s1"), []

    def load() -> DataFrame:
        loads.append(1)
        return ten_minutes(spark, d).select("route", "bin", "y")

    for _ in range(2):
        out = readers.cached_table(spark, path, load)
    if len(loads) != 1:
        raise AssertionError("the cache was not read")
    return rounded(out, "y")


def _csv(df: DataFrame, order: str, name: str) -> str:
    """df as CSV files, numbered in that order, as an outside system would export it in parts."""
    path = fresh(df.sparkSession, name)
    df.orderBy(order).drop(order).write.option("header", True).csv(path)
    return path


def _text(t, pattern: str = "yyyy-MM-dd'T'HH:mm:ss'Z'"):
    return F.date_format(F.timestamp_seconds(t), pattern)


@register("s3_observations", f"with {_SLIM} select t, route as route_id, round(value) as duration from e where event_id % 50 <> 0 and route = 'view'")
def s3(spark, d):
    """A travel-time export read with its schema; rows without a readable time go, one route is kept."""
    e = slim(spark, d)
    at = F.when(F.col("event_id") % 50 == 0, "not a time").otherwise(_text(F.col("t")))
    path = _csv(e.select("event_id", at.alias("observed_at"), F.col("route").alias("route_id"), F.lit("A").alias("direction"), F.lit("OK").alias("status"), F.lit(1000).alias("distance_m"), F.round("value").cast("long").alias("duration_sec"), F.lit(None).cast("long").alias("duration_in_traffic_sec"), F.lit("").alias("error_message")), "event_id", "s3")
    return readers.observations(spark, path, "view").select(F.unix_seconds("ts").alias("t"), "route_id", F.col("duration_sec").cast("double").alias("duration"))


@register("s5_rain", f"with {_SLIM}, r as (select *, floor(t/600)*600 as s from e where event_id % 10 <> 0) select cast(s as bigint) as t, round(arg_min(value, event_id),6) as value_mm from r group by 1")
def s5(spark, d):
    """Rain readings: unreadable values go, of one instant the first in file order stays."""
    e = slim(spark, d).withColumn("s", F.floor(F.col("t") / 600) * 600)
    value = F.when(F.col("event_id") % 10 == 0, "no value").otherwise(F.col("value").cast("string"))
    path = _csv(e.select("event_id", _text(F.col("s")).alias("timestamp"), F.lit("S1").alias("station_id"), value.alias("value_mm")), "event_id", "s5")
    return rounded(readers.readings(spark, path).select(F.unix_seconds("ts").alias("t"), "value_mm"), "value_mm")


@register("s6_forecasts", f"with {_SLIM} select event_id, t + case when event_id % 3 = 0 then 600 when event_id % 3 = 1 then 300 else 0 end as available, (event_id % 4 in (1, 2))::int as rain, (event_id % 4 = 2)::int as heavy from e where event_id % 20 <> 0")
def s6(spark, d):
    """Forecasts with the time from which they are known: the update, or ten minutes after the issue, never before it."""
    e = slim(spark, d)
    update = F.when(F.col("event_id") % 3 == 1, _text(F.col("t") + 300)).when(F.col("event_id") % 3 == 2, _text(F.col("t") - 60))
    words = F.element_at(F.array(F.lit("Fair"), F.lit("Light Rain"), F.lit("Heavy Thundery Showers"), F.lit("Cloudy")), (F.col("event_id") % 4 + 1).cast("int"))
    valid = F.when(F.col("event_id") % 20 == 0, "?").otherwise(_text(F.col("t")))
    path = _csv(e.select(F.col("event_id").alias("_o"), _text(F.col("t")).alias("issue_timestamp"), valid.alias("valid_start"), _text(F.col("t") + 7200).alias("valid_end"), F.col("event_id").cast("string").alias("area"), words.alias("forecast"), update.alias("update_timestamp")), "_o", "s6")
    return readers.forecasts(spark, path).select(F.col("area").cast("long").alias("event_id"), F.unix_seconds("available_at").alias("available"), "rain", "heavy")


@register("s7_frames", f"with {_SLIM}, r as (select *, cast(floor(t/600)*600 as bigint) as s from e where event_id % 9 <> 0) select s as t, round(arg_max(value, event_id),6) as a, cast(arg_max(event_id, event_id) as double) as b from r group by 1")
def s7(spark, d):
    """Camera counts: local times become UTC, status ok only, of one instant the last in file order."""
    e = slim(spark, d).withColumn("s", F.floor(F.col("t") / 600) * 600)
    status = F.when(F.col("event_id") % 9 == 0, "missing_frame").otherwise("ok")
    path = _csv(e.select("event_id", _text(F.col("s") + 28800, "yyyy-MM-dd'T'HH:mm:ss").alias("frame_ts"), status.alias("status"), F.col("value").alias("a"), F.col("event_id").cast("double").alias("b")), "event_id", "s7")
    return rounded(readers.frames(spark, path).select(F.unix_seconds("ts").alias("t"), "a", "b"), "a")


_PAGES = f"with {_SLIM}, p as (select strftime(to_timestamp(t) at time zone 'UTC', '%Y-%m-%d') as day, case when event_id % 3 = 0 then 1 when event_id % 3 = 1 then 2 else 3 end as page, count(*) as n from e group by 1, 2) select day, cast(page as bigint) as page, 'ok' as state, n from p"


def day_feed(spark, d, name: str) -> tuple[str, str, str]:
    """A day feed in three pages a day, followed by their tokens: (address, first day, last day)."""
    folder = sinks.qualified(spark, fresh(spark, name))
    token = F.element_at(F.array(F.lit("first"), F.lit("b"), F.lit("c")), (F.col("event_id") % 3 + 1).cast("int"))
    day = _text(F.col("t"), "yyyy-MM-dd")
    counts = slim(spark, d).groupBy(day.alias("day"), token.alias("token")).agg(F.count("*").alias("n"))
    after = F.when(F.col("token") == "first", "b").when(F.col("token") == "b", "c")
    body = F.to_json(F.struct(F.lit(0).alias("code"), F.struct(F.col("n"), after.alias("paginationToken")).alias("data")))
    counts.select("day", "token", body.alias("body")).repartition(1, "day", "token").write.partitionBy("day", "token").text(folder)
    span = counts.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    found = spark.read.format("binaryFile").load(folder).select("path")
    names = {(r.day, r.token): r.path for r in found.select(F.regexp_extract("path", "day=([^/]+)", 1).alias("day"), F.regexp_extract("path", "token=([^/]+)", 1).alias("token"), "path").collect()}
    for (day_, token_), path in names.items():  # a page's address is its day and token; one per day of the feed
        sinks.replace(spark, path, f"{folder}/pages/{day_}-{token_}.json")
    return f"{folder}/pages/{{day}}-{{token}}.json", span.a, span.b


def _read_pages(pages: DataFrame) -> DataFrame:
    return pages.select("day", F.col("page").cast("long").alias("page"), "state", F.get_json_object("body", "$.data.n").cast("long").alias("n"))


@register("s11_day_pages", _PAGES)
def s11(spark, d):
    """A span of days, one task a day, each following its tokens."""
    return _read_pages(rest.days(spark, *day_feed(spark, d, "s11")))


@register("st1_polled_days", _PAGES)
def st1(spark, d):
    """The same feed polled as a stream: it stops when the days that are complete are read, and goes on from its checkpoint when more are."""
    from ..streaming.closed_bins import run_available

    url, first, last = day_feed(spark, d, "st1")
    at = fresh(spark, "st1-out")
    from datetime import date, timedelta

    span = (date.fromisoformat(last) - date.fromisoformat(first)).days
    for part in (3, 2, 1, 1):
        until = (date.fromisoformat(first) + timedelta(days=span // part)).isoformat()
        run_available(rest.polled_days(spark, url, first, until), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return _read_pages(spark.read.schema(rest.SCHEMA).parquet(f"{at}/out"))


@register("s15_frame_files", f"with {_SLIM}, f as (select distinct route, strftime(to_timestamp(t) at time zone 'UTC', '%Y%m') as month, strftime(to_timestamp(t) at time zone 'UTC', '%d') as day from e) select route as camera_id, month, count(*) as files from f where route in ('view', 'click') group by 1, 2")
def s15(spark, d):
    """A store of files under camera and month folders, of which two cameras' are listed."""
    root = fresh(spark, "s15")
    e = slim(spark, d)
    days = e.select(F.col("route").alias("camera_id"), _text(F.col("t"), "yyyyMM").alias("month"), _text(F.col("t"), "dd").alias("day")).distinct()
    days.repartition(8).select("camera_id", "month", F.col("day").alias("value"), F.col("day").alias("d")).write.partitionBy("camera_id", "month", "d").text(root)
    files = readers.frame_files(spark, root, ["view", "click"], None, "*.txt")
    return files.groupBy("camera_id", F.col("month").cast("string").alias("month")).agg(F.count("*").alias("files"))


_GT = "b as (select l_orderkey as frame, l_returnflag as cls, (l_partkey % 40)*1.0::double as x, (l_suppkey % 30)*1.0::double as y, 10.0::double + l_linenumber as w, 8.0::double + l_linenumber as h from lineitem)"


def _truth(spark, d) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select(F.col("l_orderkey").alias("frame"), F.col("l_returnflag").alias("cls"), (F.col("l_partkey") % 40).cast("double").alias("x"), (F.col("l_suppkey") % 30).cast("double").alias("y"), (F.col("l_linenumber") + 10.0).alias("w"), (F.col("l_linenumber") + 8.0).alias("h"))


@register("s16_coco", f"with {_GT} select frame, cls, x, y, w, h from b")
def s16(spark, d):
    """Ground truth in COCO files, one a thousand frames: corners become centres."""
    names = F.array(*(F.struct(F.lit(i).cast("long").alias("id"), F.lit(c).alias("name")) for i, c in enumerate("ANR")))
    box = F.array(F.col("x") - F.col("w") / 2, F.col("y") - F.col("h") / 2, F.col("w"), F.col("h"))
    own = F.struct(F.col("frame").alias("image_id"), (F.instr(F.lit("ANR"), F.col("cls")) - 1).cast("long").alias("category_id"), box.alias("bbox"))
    files = _truth(spark, d).groupBy(F.floor(F.col("frame") / 1000).alias("part")).agg(F.collect_list(own).alias("annotations"))
    path = fresh(spark, "s16")
    texts = files.select(F.concat("part", F.lit(".json")).alias("name"), F.to_json(F.struct(F.col("annotations"), names.alias("categories"))).alias("text"))
    return readers.coco_texts(readers.text_files(sinks.text_files(texts, path, per_folder=100), path))


@register("s16_yolo", f"with {_GT} select cast(frame as bigint) as frame, cls, round(x,6) as x, round(y,6) as y, w, h from b where frame % 50 = 0")
def s16_yolo(spark, d):
    """The same for every fiftieth frame as normalised text files, one a frame."""
    t = _truth(spark, d).filter("frame % 50 = 0")
    line = F.concat_ws(" ", "cls", *((F.col(c) / F.lit(s)).cast("string") for c, s in (("x", 640.0), ("y", 480.0), ("w", 640.0), ("h", 480.0))))
    path = fresh(spark, "s16y")
    # dealt by number of lines, some of them a frame: by their few bytes they would all be taken together
    tasks = max(spark.sparkContext.defaultParallelism, t.count() // 4000)
    files = t.select("frame", line.alias("value")).repartition(tasks, "frame").groupBy("frame").agg(F.array_join(F.collect_list("value"), "\n").alias("text"))
    folders = sinks.text_files(files.select(F.concat("frame", F.lit(".txt")).alias("name"), "text"), path)
    out = readers.yolo_texts(readers.text_files(folders, path), 640.0, 480.0).withColumn("frame", F.col("frame").cast("long"))
    return rounded(out, "x", "y", "w", "h")


@register("ax1_payloads", f"with {_SLIM}, c as (select event_id, cast(round(value) as bigint) as a, event_id % 5 as b, event_id % 3 as u from e) select event_id, case when event_id % 11 = 0 then 'unreadable' when event_id % 13 = 0 then 'unavailable' when event_id % 17 = 0 then 'counts' when event_id % 19 = 0 then 'total' end as reason, case when event_id % 11 <> 0 and event_id % 13 <> 0 and event_id % 17 <> 0 and event_id % 19 <> 0 then a + b + u end as total from c")
def ax1(spark, d):
    """Count payloads, strictly parsed; the rejected with their reason."""
    a, b, u = F.round("value").cast("long"), F.col("event_id") % 5, F.col("event_id") % 3
    k = F.col("event_id")
    fields = F.struct((k % 13 != 0).alias("available"), F.lit("c1").alias("camera_id"), F.when(k % 17 == 0, -1).otherwise(a).alias("a"), b.alias("b"), u.alias("unknown"), (a + b + u + F.when(k % 19 == 0, 1).otherwise(0)).alias("total"))
    text = F.when(k % 11 == 0, "{broken").otherwise(F.to_json(fields))
    good, bad = readers.payloads(slim(spark, d).select("event_id", text.alias("body")), "body")
    return good.select("event_id", F.lit(None).cast("string").alias("reason"), "total").unionByName(bad.select("event_id", "reason", F.lit(None).cast("long").alias("total")))


@register("ax12_read_window", f"with {B10}, m as (select max(bin)*600 as last from bins), w as (select greatest(last - 5*86400, (select min(bin)*600 from bins)) - 7*86400 as a, last + 1800 + 600 as b from m) select route, count(*) as n, min(bin) as first, max(bin) as last from bins, w where bin*600 >= a and bin*600 < b group by 1")
def ax12(spark, d):
    """What is read for origins of the last five days: a week of features before, labels after, not before the history."""
    from ..operators import rows

    b = ten_minutes(spark, d)
    span = b.agg(F.min("bin").alias("a"), F.max("bin").alias("b")).first()
    if span.a is None:
        return b.groupBy("route").agg(F.count("*").alias("n"), F.min("bin").alias("first"), F.max("bin").alias("last"))
    start, end = rows.read_window(span.a * 600, span.b * 600, look_back_s=5 * 86400, history_s=span.a * 600)
    return b.filter((F.col("bin") * 600 >= start) & (F.col("bin") * 600 < end)).groupBy("route").agg(F.count("*").alias("n"), F.min("bin").alias("first"), F.max("bin").alias("last"))


@register("ax21_day_window", f"with {_SLIM}, d as (select *, cast(floor(t/86400) as bigint) as day from e) select day, count(*) as n from d where day between (select max(day) from d) - 7 and (select max(day) from d) - 1 group by 1")
def ax21(spark, d):
    """The last week up to yesterday, as a backfill would fetch it; a window in the future is refused."""
    from datetime import date, timedelta

    from ..operators import rows

    e = slim(spark, d).withColumn("day", F.floor(F.col("t") / 86400).cast("long"))
    today = e.agg(F.max("day")).first()[0] or 0
    iso = lambda k: (date(1970, 1, 1) + timedelta(days=k)).isoformat()
    first, last = ((date.fromisoformat(x) - date(1970, 1, 1)).days for x in rows.day_window(None, None, iso(today)))
    return e.filter(F.col("day").between(first, last)).groupBy("day").agg(F.count("*").alias("n"))
