"""Streams with state of one's own: the last row and a rolling sum of every key, files read once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "user_id long, n long, cents long, last_at long, last_id long, last_type string, n_late long"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_NEW = (0, 0, None, None, None, 0)
_NEVER = -(2**63)
#: Keys that differ in so many of their lowest bits share a block: at most 128 keys, however many there are in all.
_BLOCK_BITS = 7


class Rolling(StatefulProcessor):
    """Of every key: rows, their sum in hundredths, the latest row by time, then id, and how many rows were older than the latest one
    of earlier batches.  State is one row a key, whatever the number of its events; the rows of a block of keys are one list, and a
    call works out all keys of a block at once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {r[0]: tuple(r[1:]) for r in self.held.get()}
        before = pd.Series({u: r[2] for u, r in held.items() if r[2] is not None}, dtype="int64")
        touched = set()
        for pdf in rows:
            pdf = pdf.assign(late=pdf["at"].to_numpy() < before.reindex(pdf["user_id"], fill_value=_NEVER).to_numpy())
            sums = pdf.groupby("user_id").agg(n=("user_id", "size"), cents=("cents", "sum"), late=("late", "sum"))
            tops = pdf.sort_values(["user_id", "at", "event_id"], na_position="first").drop_duplicates("user_id", keep="last")  # in the order of sums
            touched.update(sums.index.tolist())
            for u, n, cents, late, at, i, kind in zip(*(c.tolist() for c in (sums.index, sums["n"], sums["cents"], sums["late"], tops["at"], tops["event_id"], tops["event_type"]))):
                n_, cents_, last_at, last_id, last_type, late_ = held.get(u, _NEW)
                if at == at and (last_at is None or (at, i) > (last_at, last_id)):  # a row without a time is never the latest
                    last_at, last_id, last_type = int(at), int(i), kind
                held[u] = (n_ + n, cents_ + int(cents), last_at, last_id, last_type, late_ + late)
        self.held.put([(u, *r) for u, r in held.items()])
        yield pd.DataFrame([(u, *held[u]) for u in sorted(touched)], columns=_COLUMNS)

    def close(self) -> None:
        pass


def rolling(spark: SparkSession, source: str, schema, checkpoint: str, out: str, files: int = 1) -> None:
    """Take in every file that is new since the last call, ``files`` at a time, and write the rows of the keys it touched.

    A batch's rows are written under its number, and a batch run twice replaces itself; state and progress are in ``checkpoint``, so a
    restart goes on where the last call stopped.
    """
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
        given = stream.select(F.col("user_id").cast("long").alias("user_id"), "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.round(F.col("value") * 100).cast("long").alias("cents"))
        blocks = given.filter(F.col("user_id").isNotNull()).withColumn("block", F.shiftright("user_id", _BLOCK_BITS))
        found = blocks.groupBy("block").transformWithStateInPandas(Rolling(), SCHEMA, "Update", "None")

        def sink(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        found.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)


def latest(spark: SparkSession, out: str) -> DataFrame:
    """Of every key what its last batch wrote."""
    rows = spark.read.schema(f"{SCHEMA}, batch long").parquet(out)
    return rows.groupBy("user_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("user_id", "batch")]), "batch").alias("r")).select("user_id", "r.*")
