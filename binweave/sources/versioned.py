"""Versioned tables: immutable data folders, one manifest per version, and commits that fail rather than overwrite.

Version n is the file versions/n.json: its parent's folders, those added, and the schema. A
commit writes data to folders of its own, then moves a manifest into place under the next
number, which fails if another writer was first (the file system's rename without overwrite).
A reader sees a whole version or the one before; a crash leaves folders that no manifest
names. Nothing is deleted in place, so that old versions can be read until `expire` drops them.

Guards look at what they were checked against: a commit that lost the race checks again
against the new version (append) or gives up (replace, upsert), so that no two loads of one
time range both get in.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.joins import not_yet, upserted


class Conflict(Exception):
    """Another writer committed first."""


class Refused(ValueError):
    """A guard does not let the rows in."""


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
        self._fs = self._path("versions").getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("versions").toUri(), spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the versions that can be read, in order."""
        if not self._fs.exists(self._path("versions")):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(self._path("versions")) if s.getPath().getName().endswith(".json"))

    def latest(self) -> int:
        """0 before the first commit."""
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/versions/{version}.json", wholetext=True).first()[0])

    def history(self) -> list[dict]:
        return [self.manifest(v) for v in self.versions()]

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the latest if none is given."""
        at = self.manifest(self.latest() if version is None else version)
        schema = StructType.fromJson(at["schema"])
        if not at["folders"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/data/{f}" for f in at["folders"]))

    def _commit(self, parent: int, folders: list[str], schema: dict, what: str, note: str) -> int:
        number, path = parent + 1, self._path(f"versions/{uuid.uuid4().hex}.tmp")
        out = self._fs.create(path, False)
        out.write(bytearray(json.dumps({"version": number, "parent": parent, "operation": what, "note": note, "folders": folders, "schema": schema}, sort_keys=True).encode()))
        out.close()
        try:
            # without overwriting: the loser of a race gets an error
            self._context.rename(path, self._path(f"versions/{number}.json"), self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            self._fs.delete(path, False)
            if "AlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {number} of {self.root} is there already") from e
            raise
        return number

    def _written(self, df: DataFrame, partition: str | None = None) -> str:
        name = uuid.uuid4().hex
        w = df.write
        (w.partitionBy(partition) if partition else w).parquet(f"{self.root}/data/{name}")
        return name

    def create(self, schema: str | StructType) -> int:
        """The first, empty version; nothing if there is one."""
        if self.latest():
            return self.latest()
        kind = schema if isinstance(schema, StructType) else self.spark.createDataFrame([], schema).schema
        try:
            return self._commit(0, [], json.loads(kind.json()), "create", "")
        except Conflict:
            return self.latest()

    def append(self, df: DataFrame, columns: list[str] | None = None, guard: Callable[[DataFrame], None] | None = None, tries: int = 5, note: str = "") -> int:
        """The rows of df added, in a fixed projection. guard sees the version they are added to, and raises to refuse them; after a lost race it looks again."""
        self.create(df.select(*(columns or df.columns)).schema)
        names = StructType.fromJson(self.manifest(self.latest())["schema"]).names
        folder = None
        for _ in range(tries):
            parent = self.latest()
            if guard:
                guard(self.read(parent))
            folder = folder or self._written(df.select(*names))
            at = self.manifest(parent)
            try:
                return self._commit(parent, [*at["folders"], folder], at["schema"], "append", note)
            except Conflict:
                continue
        raise Conflict(f"{tries} tries to append to {self.root} lost against other writers")

    def append_guarded(self, df: DataFrame, time: str, note: str = "") -> int:
        """An append that is refused if any row already lies in the time range of df."""
        span = df.agg(F.min(time).alias("a"), F.max(time).alias("b")).first()

        def guard(now: DataFrame) -> None:
            if not now.filter(F.col(time).between(F.lit(span.a), F.lit(span.b))).isEmpty():
                raise Refused(f"{self.root} already has rows from {span.a} to {span.b}")

        return self.append(df, guard=guard, note=note)

    def append_new(self, df: DataFrame, keys: list[str]) -> int:
        """Only the rows whose keys aren't there yet: a load that can be resumed and repeated."""
        parent = self.create(df.schema)
        parent = self.latest()
        at = self.manifest(parent)
        return self._commit(parent, [*at["folders"], self._written(not_yet(df, self.read(parent), keys))], at["schema"], "append_new", "")

    def replace(self, df: DataFrame, partition: str | None = None, expected: int | None = None, note: str = "") -> int:
        """Other contents, on top of `expected` (the latest version if not given)."""
        parent = self.latest() if expected is None else expected
        return self._commit(parent, [self._written(df, partition)], json.loads(df.schema.json()), "replace", note)

    def upsert(self, df: DataFrame, keys: list[str]) -> int:
        """The rows of df in place of those of equal key, or added; made on one version and committed on that alone."""
        parent = self.latest()
        if not parent:
            return self.append(df)
        return self.replace(upserted(self.read(parent), df, keys), expected=parent, note="upsert")

    def promote(self, version: int) -> int:
        """An old version's contents as the newest one: its folders are named again, nothing is copied."""
        at = self.manifest(version)
        return self._commit(self.latest(), at["folders"], at["schema"], "promote", str(version))

    def expire(self, keep: int) -> list[str]:
        """Drop manifests but the newest `keep`, and data folders that none of those name; a writer's folders that aren't committed yet go too, so only while nobody writes."""
        old = self.versions()[:-keep]
        kept = {f for v in self.versions()[-keep:] for f in self.manifest(v)["folders"]}
        for v in old:
            self._fs.delete(self._path(f"versions/{v}.json"), False)
        gone = [s.getPath().getName() for s in self._fs.listStatus(self._path("data"))] if self._fs.exists(self._path("data")) else []
        gone = [f for f in gone if f not in kept]
        for f in gone:
            self._fs.delete(self._path(f"data/{f}"), True)
        return gone
