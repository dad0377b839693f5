"""What the operators share: the folder all machines see, Arrow batches, word patterns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_own_dir: dict[str, str] = {}
_kept: dict[str, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent (a local session, as in tests) a local folder stands in.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_dir.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="factloom-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage so that a lost executor costs one stage."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._factloom_path = path
    return table


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose result is written.

    They go when the driver's objects are collected; events under way may hold those a moment longer, hence several rounds, and
    the files are deleted in the background, for which a busy machine, told by the time a collection takes, gets more time.
    """
    for _ in range(3):
        gc.collect()
        began = time.monotonic()
        spark.sparkContext._jvm.System.gc()
        time.sleep(min(2.0, 0.2 + 2 * (time.monotonic() - began)))


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later step reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._factloom_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Give what earlier tasks of this Python worker have freed back to the system; without glibc nothing happens."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def kept(kind: str, key: object, make: Callable[[], object]) -> object:
    """What a Python worker holds on to between batches: one thing only, so a worker that serves several operators in turn does
    not gather their tables."""
    held = _kept.get("one")
    if held is None or held[0] != (kind, key):
        _kept["one"] = held = None
        trim()
        _kept["one"] = held = ((kind, key), make())
    return held[1]


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names, whatever else the table has."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def per_text(df: DataFrame, fn: Callable[[list, list[str]], dict], schema: str, chars: int = 250_000) -> DataFrame:
    """mapInArrow over (doc_id, text) in pieces of about ``chars`` code points; null texts are given as empty.

    ``fn(ids, texts)`` returns columns by name in the order of ``schema``; a text is never split.
    """
    out = pa.schema(_arrow_fields(df.sparkSession, schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for batch in batches:
            for ids, rows in pieces(batch, chars):
                columns = fn(ids, rows)
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def _arrow_fields(spark: SparkSession, schema: str) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return [pa.field(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema)]


def pieces(batch: pa.RecordBatch, chars: int) -> Iterator[tuple[list, list[str]]]:
    ids, rows = batch.column(0).to_pylist(), batch.column(1)
    i, n = 0, len(ids)
    while i < n:
        got: list[str] = []
        size, start = 0, i
        while i < n and (size < chars or not got):
            text = rows[i].as_py() or ""
            got.append(text)
            size += len(text)
            i += 1
        yield ids[start:i], got


def rows_of(docs: DataFrame, ids: DataFrame, key: str, bound: int = 1_000_000) -> DataFrame:
    """The rows whose key is among ``ids`` (column ``id``, distinct, written out): sent to all tasks up to ``bound`` ids, joined beyond."""
    few = ids.limit(bound + 1).count() <= bound
    side = ids.withColumnRenamed("id", "_id")
    return docs.join(F.broadcast(side) if few else side, F.col(key).cast("long").eqNullSafe(F.col("_id")), "left_semi")


def rows_without(docs: DataFrame, ids: DataFrame, key: str, bound: int = 1_000_000) -> DataFrame:
    """The rows whose key is not among ``ids`` (as in ``rows_of``)."""
    few = ids.limit(bound + 1).count() <= bound
    side = ids.withColumnRenamed("id", "_id")
    return docs.join(F.broadcast(side) if few else side, F.col(key).cast("long").eqNullSafe(F.col("_id")), "left_anti")


def text_udf(fn: Callable[[list], list], returns: str):
    """A pandas UDF of one column from a function on lists."""

    @F.pandas_udf(returns)
    def run(rows: pd.Series) -> pd.Series:
        trim()
        return pd.Series(fn([None if t is None else t for t in rows]), index=rows.index, dtype="bool" if returns == "boolean" else "object")

    return run
