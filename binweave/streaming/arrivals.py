"""Replays of a table as a stream: slices arrive one by one, the query stops and starts again between them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.scratch import fresh

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB for the streams run inside; the caller's setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def replayed(rows: DataFrame, arrival: str, slices: int, run: Callable[[DataFrame, str, str], StreamingQuery], name: str, repeat: bool = False) -> str:
    """The sink's path after rows came in by `arrival` (0 to slices - 1), a slice at a time.

    run(stream, sink path, checkpoint) starts a query that ends when it has read what is there; it is started anew for every slice, with
    one checkpoint. With repeat every slice is delivered twice.
    """
    spark = rows.sparkSession
    at = fresh(spark, name)
    rest = [c for c in rows.columns if c != arrival]
    schema = rows.select(*rest).schema
    for k in range(slices):
        for copy in range(1 + repeat):
            rows.filter(F.col(arrival) == k).select(*rest).write.mode("append").parquet(f"{at}/in/slice={k}-{copy}")
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{at}/in")
            run(stream, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return f"{at}/out"
