"""A fresh folder that driver and executors share, for streams and versioned tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir; in local mode, where that is unset, under a temporary folder of the session; an error on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("binweave.scratch.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="binweave-")
        spark.conf.set("binweave.scratch.dir", base)
    return f"{base}/{name}-{uuid.uuid4().hex}"
