"""Versioned run folders: a manifest of tables with fingerprints, promotion under a check, a pointer to the latest, and replay without refitting."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from .sinks import exists, fingerprints, one_csv, replace


def _write(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    replace(spark, f"{path}.tmp", path)


def _read(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def fingerprint(spark: SparkSession, path: str) -> str:
    """One SHA-256 of all files of a table, whatever they are called."""
    import hashlib

    own = sorted(r.sha256 for r in fingerprints(spark, path).collect())  # one row per file of a run's small tables
    return hashlib.sha256("".join(own).encode()).hexdigest()


def write_run(spark: SparkSession, root: str, version: str, tables: dict[str, DataFrame], config: dict) -> str:
    """A new run folder with its tables and a manifest of their columns and fingerprints; never over an old one."""
    folder = f"{root}/{version}"
    if exists(spark, folder):
        raise ValueError(f"{folder} is there already")
    entries = {}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
        entries[name] = {"columns": df.columns, "sha256": fingerprint(spark, f"{folder}/{name}")}
    _write(spark, f"{folder}/manifest.json", json.dumps({"version": version, "config": config, "tables": entries}, sort_keys=True))
    return folder


def validated(spark: SparkSession, folder: str) -> dict:
    """A run's manifest, or an error if a table is missing, has other columns or other contents."""
    manifest = json.loads(_read(spark, f"{folder}/manifest.json"))
    for name, entry in manifest["tables"].items():
        path = f"{folder}/{name}"
        if not exists(spark, path):
            raise ValueError(f"{name} is missing")
        if spark.read.parquet(path).columns != entry["columns"]:
            raise ValueError(f"{name} has other columns")
        if fingerprint(spark, path) != entry["sha256"]:
            raise ValueError(f"{name} has changed")
    return manifest


def promote(spark: SparkSession, root: str, version: str) -> None:
    """Point `latest` at a run that holds what its manifest says."""
    validated(spark, f"{root}/{version}")
    _write(spark, f"{root}/latest.json", json.dumps({"version": version}))


def latest(spark: SparkSession, root: str) -> str:
    return json.loads(_read(spark, f"{root}/latest.json"))["version"]


def replay(spark: SparkSession, folder: str, figures: dict[str, tuple[str, list[str]]], target: str, protected: tuple[str, ...] = ()) -> None:
    """A CSV file per figure (name -> table, columns) from a validated run; nothing is fitted anew. A protected target is refused."""
    if any(target == p or target.startswith(p.rstrip("/") + "/") for p in protected):
        raise ValueError(f"{target} is protected")
    manifest = validated(spark, folder)
    for name, (table, columns) in figures.items():
        if table not in manifest["tables"]:
            raise ValueError(f"no table {table} in the run")
        one_csv(spark.read.parquet(f"{folder}/{table}").select(*columns), f"{target}/{name}.csv", columns)
