"""Incremental runs: files that arrive are scored once, rolling results are kept per key, late events have a bound."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def catch_up(spark: SparkSession, source: str, schema, checkpoint: str, sink: Callable[[DataFrame, int], None], files: int = 100) -> None:
    """Hand every file that is new since the last call to ``sink`` in micro-batches, then stop."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def partial_counts(batch: DataFrame, keys: list[str], value: str) -> DataFrame:
    return batch.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.round(F.col(value) * 100).cast("long")).alias("cents"))


def append_partials(path: str, keys: list[str], value: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch's partial sums under its batch number: a batch run twice replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        partial_counts(batch, keys, value).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def rolled_up(partials: DataFrame, keys: list[str]) -> DataFrame:
    return partials.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))


def windowed(stream: DataFrame, time: str, size: str, late: str, keys: list[str]) -> DataFrame:
    """Counts by tumbling window; events later than ``late`` behind the latest are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"))
