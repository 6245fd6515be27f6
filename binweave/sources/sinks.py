"""Sinks: fixed projections, guarded appends, resumable writes, snapshots and fingerprints."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import not_yet, upserted


def append(df: DataFrame, path: str, columns: list[str], partition: str | None = None) -> None:
    w = df.select(*columns).write.mode("append")
    (w.partitionBy(partition) if partition else w).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme and authority, as readers outside Spark's file systems need it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return str(p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p))


def guarded_append(df: DataFrame, path: str, time: str) -> None:
    """Append, unless rows of the same time range are there already."""
    spark = df.sparkSession
    if exists(spark, path):
        span = df.agg(F.min(time).alias("a"), F.max(time).alias("b")).first()
        if spark.read.parquet(path).filter(F.col(time).between(span.a, span.b)).limit(1).count():
            raise ValueError(f"{path} already has rows from {span.a} to {span.b}")
    append(df, path, df.columns)


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys aren't there yet: a load that can be resumed."""
    spark = df.sparkSession
    append(not_yet(df, spark.read.parquet(path), keys) if exists(spark, path) else df, path, df.columns)


def upsert(df: DataFrame, path: str, keys: list[str], to: str) -> None:
    """Write to a new path the table at `path` with the rows of df put in."""
    spark = df.sparkSession
    (upserted(spark.read.parquet(path), df, keys) if exists(spark, path) else df).write.mode("overwrite").parquet(to)


def snapshot(df: DataFrame, key: str, t: str, columns: list[str], now: int, span_s: int = 86400) -> DataFrame:
    """Per key the points of the last span in order, ready for to_json."""
    recent = df.filter(F.col(t) >= now - span_s)
    return recent.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(t, *columns))).alias("points"))


def plot_series(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with NaN and infinities empty."""
    clean = [F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.select(*columns).dtypes]
    df.select(*clean).write.mode("overwrite").option("header", True).csv(path)


def text_files(df: DataFrame, root: str, per_folder: int = 1000) -> DataFrame:
    """df(name, text) as a file a row, written by the tasks that hold the rows -> the folders written (folder, files); names must differ.

    A task fills folders of its own, and only folders named in the tasks' results count, so files of failed attempts are
    never read. The driver sees folders only: a file costs neither a commit nor a listing there.
    """
    spark = df.sparkSession
    uri = qualified(spark, root)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(uri)
        folder, n = "", 0
        for b in batches:
            for name, text in zip(b["name"], b["text"], strict=True):
                if n == 0:
                    folder = f"{at}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                    store.create_dir(folder, recursive=True)
                with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
                    out.write(text.encode())
                n += 1
                if n == per_folder:
                    yield pd.DataFrame({"folder": [folder], "files": [n]})
                    n = 0
        if n:
            yield pd.DataFrame({"folder": [folder], "files": [n]})

    df.select("name", "text").mapInPandas(write, "folder string, files long").write.parquet(f"{root}/_folders")
    return spark.read.schema("folder string, files long").parquet(f"{root}/_folders")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, SHA-256) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Rename source to target, in place of what is there."""
    jvm = spark._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(b):
        fs.delete(b, True)
    if not fs.rename(a, b):
        raise OSError(f"cannot rename {source} to {target}")


def ensure_tables(spark: SparkSession, tables: dict[str, tuple[str, list[str]]]) -> None:
    """Create the tables that are missing. tables: name -> (columns, partition columns)."""
    for name, (columns, partitions) in tables.items():
        by = f" partitioned by ({', '.join(partitions)})" if partitions else ""
        spark.sql(f"create table if not exists {name} ({columns}) using parquet{by}")


def one_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """One sorted CSV file with a header at path, there all at once; for small keyed tables."""
    spark = df.sparkSession
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(f"{path}.tmp")
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(str(s.getPath()) for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    replace(spark, part, path)
    fs.delete(folder, True)


def upsert_csv(df: DataFrame, path: str, keys: list[str], schema: str) -> None:
    """A small keyed CSV file with the rows of df in place of those of equal key, or added, sorted by key."""
    spark = df.sparkSession
    now = upserted(spark.read.schema(schema).option("header", True).csv(path), df, keys) if exists(spark, path) else df
    one_csv(now, path, keys)


def done_keys(spark: SparkSession, path: str, key: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """Keys a resumable sink has: of a Parquet table, a CSV file, or a folder of files (their names without ending)."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{key} string")
    if kind == "folder":
        name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
        return spark.read.format("binaryFile").load(path).select(name.alias(key)).distinct()
    reader = spark.read.schema(schema).option("header", True).csv if kind == "csv" else spark.read.parquet
    return reader(path).select(key).distinct()


def guarded_load(loads: dict[str, tuple[DataFrame, str]], snapshots: str | None = None) -> None:
    """Append several tables (path -> rows, time column), or none: all ranges are checked before the first write; old tables are copied beside, if wanted."""
    for path, (df, time) in loads.items():
        spark = df.sparkSession
        if exists(spark, path):
            span = df.agg(F.min(time).alias("a"), F.max(time).alias("b")).first()
            if spark.read.parquet(path).filter(F.col(time).between(span.a, span.b)).limit(1).count():
                raise ValueError(f"{path} already has rows from {span.a} to {span.b}")
    for path, (df, _) in loads.items():
        if snapshots and exists(df.sparkSession, path):
            df.sparkSession.read.parquet(path).write.parquet(f"{snapshots}/{path.rstrip('/').rsplit('/', 1)[-1]}")
    for path, (df, _) in loads.items():
        append(df, path, df.columns)
