"""Typed readers: explicit schemas, coercion to null instead of failure, and one clock (UTC)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OBSERVATION = "observed_at string, route_id string, direction string, status string, distance_m long, duration_sec long, duration_in_traffic_sec long, error_message string"


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def instant(text: Column, zone: str = "UTC") -> Column:
    """A time in ISO form, compact form, epoch seconds or milliseconds; without an offset it is of the zone. Years 2000 to 2100, else null."""
    iso = F.try_to_timestamp(F.regexp_replace(text, "T", " "))
    naive = ~text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    local = F.when(naive, F.to_utc_timestamp(iso, zone)).otherwise(iso)
    digits = F.regexp_extract(text, r"^(\d+)$", 1)
    number = F.when(F.length(digits).between(9, 10), F.timestamp_seconds(digits.try_cast("long"))).when(F.length(digits) == 13, F.timestamp_millis(digits.try_cast("long")))
    # the pattern is tried on texts of its shape only: a text that fails it costs an exception
    shape = F.regexp_extract(text, r"^(\d{8}[_-]?\d{6})$", 1)
    compact = F.when(shape != "", F.to_utc_timestamp(F.try_to_timestamp(F.regexp_replace(shape, "[_-]", ""), F.lit("yyyyMMddHHmmss")), zone))
    out = F.coalesce(number, compact, local)
    return F.transform(F.array(out), lambda v: F.when(F.year(v).between(2000, 2100), v))[0]  # worked out once, though used twice


def file_order() -> Column:
    """Where a row stood: by file name, then by place in the file, whatever splits and tasks read it."""
    return F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))


def observations(spark: SparkSession, path: str, route: str | None = None) -> DataFrame:
    """Travel-time rows with a parsed instant; carried rows keep their message."""
    out = csv(spark, path, OBSERVATION).withColumn("ts", instant(F.col("observed_at"))).filter("ts is not null")
    return out.filter(F.col("route_id") == route) if route else out


def readings(spark: SparkSession, path: str) -> DataFrame:
    """Rain: (ts, value_mm), one per instant, the first in file order."""
    raw = csv(spark, path, "timestamp string, station_id string, value_mm double").withColumn("_pos", file_order())
    rows = raw.select(instant(F.col("timestamp")).alias("ts"), "value_mm", "_pos").na.drop()
    return rows.groupBy("ts").agg(F.min_by("value_mm", "_pos").alias("value_mm"))


def forecasts(spark: SparkSession, path: str) -> DataFrame:
    """Forecasts with available_at: the update time, or ten minutes after the issue, but never before it; and text flags."""
    raw = csv(spark, path, "issue_timestamp string, valid_start string, valid_end string, area string, forecast string, update_timestamp string")
    t = {c: instant(F.col(c)) for c in ("issue_timestamp", "valid_start", "valid_end", "update_timestamp")}
    out = raw.withColumns(t).filter("issue_timestamp is not null and valid_start is not null and valid_end is not null")
    return out.withColumns({
        "available_at": F.greatest(F.coalesce("update_timestamp", F.col("issue_timestamp") + F.expr("interval 10 minutes")), F.col("issue_timestamp")),
        "rain": F.col("forecast").rlike("(?i)rain|shower|thunder").cast("int"), "heavy": F.col("forecast").rlike("(?i)heavy|thunder").cast("int"),
    })


def frames(spark: SparkSession, path: str, zone: str = "Asia/Singapore") -> DataFrame:
    """Camera counts with status ok; local times become UTC; of equal instants the last in file order."""
    raw = csv(spark, path, "frame_ts string, status string, a double, b double").withColumn("_pos", file_order()).filter("status = 'ok'")
    rows = raw.withColumn("ts", instant(F.col("frame_ts"), zone))
    return rows.groupBy("ts").agg(F.max_by(F.struct("a", "b"), "_pos").alias("_r")).select("ts", "_r.*")


PAGE = "items array<struct<timestamp:string,readings:array<struct<station_id:string,value:double>>>>, stations array<struct<id:string,name:string>>"


def pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON pages -> (ts, station_id, value), and stations, of one id the last by page order."""
    raw = spark.read.schema(PAGE).option("multiLine", True).json(path).withColumn("_pos", file_order())
    values = raw.select(F.explode("items").alias("i")).select(instant(F.col("i.timestamp")).alias("ts"), F.explode("i.readings").alias("r")).select("ts", "r.station_id", "r.value")
    stations = raw.select("_pos", F.posexplode("stations").alias("_i", "s")).groupBy("s.id").agg(F.max_by("s.name", F.struct("_pos", "_i")).alias("name"))
    return values, stations


def forecast_pages(pages: DataFrame, json: str) -> DataFrame:
    """JSON pages of issues -> one row per item and area; a forecast is text, or an object that holds it."""
    parsed = F.from_json(json, "items array<struct<forecasts:array<struct<area:string,forecast:string>>>>")
    rest = [c for c in pages.columns if c != json]
    items = pages.select(*rest, F.explode(parsed["items"]).alias("_i")).select(*rest, F.explode("_i.forecasts").alias("_f"))
    text = F.coalesce(F.get_json_object("_f.forecast", "$.text"), F.col("_f.forecast"))
    return items.select(*rest, F.col("_f.area").alias("area"), text.alias("text"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of prediction files, one JSON object a frame: (frame, cls, x, y, w, h, confidence), centres."""
    raw = spark.read.schema("frame string, predictions array<struct<class:string,confidence:double,x:double,y:double,width:double,height:double>>").option("multiLine", True).json(path)
    p = raw.select("frame", F.explode("predictions").alias("p"))
    return p.select("frame", F.col("p.class").alias("cls"), "p.x", "p.y", F.col("p.width").alias("w"), F.col("p.height").alias("h"), "p.confidence")


def frame_files(spark: SparkSession, root: str, cameras: list[str] | None = None, months: list[str] | None = None, suffix: str = "*.jpg") -> DataFrame:
    """Files below root/camera_id=.../month=.../, of which only the wanted folders are listed and only the wanted columns read."""
    out = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", False).load(root)
    if cameras is not None:
        out = out.filter(F.col("camera_id").isin(*cameras))
    return out.filter(F.col("month").isin(*months)) if months is not None else out


COCO = "images array<struct<id:long,file_name:string>>, annotations array<struct<image_id:long,category_id:long,bbox:array<double>>>, categories array<struct<id:long,name:string>>"


def _coco(raw: DataFrame) -> DataFrame:
    """Rows of COCO -> boxes."""
    names = F.map_from_entries(F.transform("categories", lambda c: F.struct(c["id"], c["name"])))  # a file's categories are its own
    a = raw.select(names.alias("names"), F.explode("annotations").alias("a")).select("names", "a.*")
    b = F.col("bbox")
    return a.withColumn("cls", F.try_element_at("names", F.col("category_id"))).filter("cls is not null").select(F.col("image_id").alias("frame"), "cls", (b[0] + b[2] / 2).alias("x"), (b[1] + b[3] / 2).alias("y"), b[2].alias("w"), b[3].alias("h"))


def coco(spark: SparkSession, path: str) -> DataFrame:
    """Ground-truth boxes of a COCO file: (frame, cls, x, y, w, h), centres."""
    return _coco(spark.read.schema(COCO).option("multiLine", True).json(path))


def coco_texts(files: DataFrame) -> DataFrame:
    """The same of files(name, text), as text_files reads them where they are too many for one listing."""
    return _coco(files.select(F.from_json("text", COCO).alias("j")).select("j.*"))


def text_files(folders: DataFrame, root: str, at_once: int = 1 << 22) -> DataFrame:
    """(name, text) of the files in the folders (folder, files) that sinks.text_files wrote below root, listed and read by the tasks that hold the folders."""
    from .sinks import qualified

    uri = qualified(folders.sparkSession, root)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(uri)
        for b in batches:
            for folder, files in zip(b["folder"], b["files"], strict=True):
                found = [i for i in store.get_file_info(fs.FileSelector(folder)) if i.is_file]
                if len(found) != files:
                    raise OSError(f"{folder} has {len(found)} of {files} files")
                rows, held = [], 0
                for i in found:
                    with store.open_input_stream(i.path, compression=None) as f:
                        rows.append((i.base_name, f.read().decode()))
                    held += len(rows[-1][1])
                    if held > at_once:
                        yield pd.DataFrame(rows, columns=["name", "text"])
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=["name", "text"])

    tasks = folders.agg(F.sum(F.ceil(F.col("files") / 1000))).first()[0] or 1
    return folders.repartition(int(tasks), "folder").mapInPandas(read, "name string, text string")


def _yolo(lines: DataFrame, width: float, height: float) -> DataFrame:
    """lines(file, value) -> boxes."""
    p = F.split("value", r"\s+")
    num = lambda i, s: p[i].cast("double") * s
    return lines.filter("trim(value) <> ''").select(F.regexp_extract("file", r"([^/]+)\.txt$", 1).alias("frame"), p[0].alias("cls"), num(1, width).alias("x"), num(2, height).alias("y"), num(3, width).alias("w"), num(4, height).alias("h"))


def yolo(spark: SparkSession, path: str, width: float, height: float) -> DataFrame:
    """Boxes of YOLO text files, normalised centres and sizes scaled to pixels; frame is the file's name."""
    return _yolo(spark.read.text(path).select(F.input_file_name().alias("file"), "value"), width, height)


def yolo_texts(files: DataFrame, width: float, height: float) -> DataFrame:
    """The same of files(name, text), as text_files reads them where they are too many for one listing."""
    return _yolo(files.select(F.col("name").alias("file"), F.explode(F.split("text", r"\r\n|\r|\n")).alias("value")), width, height)


def deduplicated(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by the order column."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def payloads(df: DataFrame, json: str) -> tuple[DataFrame, DataFrame]:
    """Strictly checked count payloads: rows (camera_id, a, b, unknown, total), and the rejected with a reason."""
    p = F.from_json(json, "available boolean, camera_id string, a long, b long, unknown long, total long")
    out = df.withColumn("p", p)
    c = [F.col(f"p.{n}") for n in ("a", "b", "unknown", "total")]
    reason = F.when(F.col("p.camera_id").isNull(), "unreadable").when(~F.coalesce("p.available", F.lit(False)), "unavailable")
    for x in c:
        reason = reason.when(x.isNull() | (x < 0), "counts")
    reason = reason.when(c[0] + c[1] + c[2] != c[3], "total")
    out = out.withColumn("reason", reason)
    return out.filter("reason is null").select(*df.columns, "p.camera_id", "p.a", "p.b", "p.unknown", "p.total"), out.filter("reason is not null").select(*df.columns, "reason")


def cached_table(spark: SparkSession, path: str, load: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The table kept at path; loaded and written there where it is missing or to be refreshed. Readers of the old files are not disturbed: a refresh writes beside them first."""
    from .sinks import exists, replace

    if refresh or not exists(spark, path):
        df = load()
        df.write.mode("overwrite").parquet(f"{path}.new")
        replace(spark, f"{path}.new", path)
    return spark.read.parquet(path)
