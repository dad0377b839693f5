"""Reading documents, line records, text corpora, images and case lists; writing tables, per-case documents and run outputs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from ..functions import text as t

IMAGE_KEY = r"^([A-Z]+[0-9]+)_(.+)\.(?:png|jpg|jpeg)$"


def json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One document a file, with the file's name; the schema is stated, so nothing is read twice."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Line records; blank and broken lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last record of each key, by partial aggregation rather than a sort."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*keys, "_r.*")


def reports(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, reader, text): a file for each case and reader."""
    files = spark.read.option("wholetext", True).text(path).withColumn("name", F.col("_metadata.file_name"))
    return files.select(t.case_of(F.col("name")).alias("case_id"), t.reader_of(F.col("name")).alias("reader"), F.col("value").alias("text"))


def reference_reports(found: DataFrame) -> DataFrame:
    """The unsuffixed report alone where there is one, else all readers'."""
    exact = F.max(F.col("reader").isNull()).over(W.partitionBy("case_id"))
    return found.withColumn("_e", exact).filter(F.col("reader").isNull() | ~F.col("_e")).drop("_e")


def first_reader(found: DataFrame) -> DataFrame:
    best = found.groupBy("case_id").agg(F.min_by(F.struct("reader", "text"), F.coalesce("reader", F.lit(""))).alias("_r"))
    return best.select("case_id", "_r.*")


def images(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, image_key, path) by file name; contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select(F.regexp_extract(name, IMAGE_KEY, 1).alias("case_id"), F.regexp_extract(name, IMAGE_KEY, 2).alias("image_key"), "path")
    return found.filter("case_id <> ''")


def sidecars(found: list[DataFrame]) -> DataFrame:
    """(case_id, entries) merged from several scans of (case_id, key, value), the later scan winning."""
    parts = None
    for i, f in enumerate(found):
        one = f.select("case_id", "key", "value", F.lit(i).alias("_i"))
        parts = one if parts is None else parts.unionByName(one)
    last = parts.groupBy("case_id", "key").agg(F.max_by("value", "_i").alias("value"))
    return last.groupBy("case_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("entries"))


def case_list(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("case_id"))
    return lines.filter("case_id <> ''")


def common_cases(a: DataFrame, b: DataFrame) -> DataFrame:
    strip = lambda c: F.regexp_replace(c, r"_[0-9]+$", "")
    return a.select(strip(F.col("case_id")).alias("case_id")).intersect(b.select(strip(F.col("case_id")).alias("case_id")))


def newest_version(names: list[str], prefix: str) -> str | None:
    """Of versioned names the highest by numbers; the plain name before any."""
    if prefix in names:
        return prefix
    found = [n for n in names if re.fullmatch(re.escape(prefix) + r"[_-]?v?[0-9.]+", n)]
    return max(found, key=lambda n: [int(x) for x in re.findall(r"[0-9]+", n[len(prefix) :])], default=None)


def fact_dimension(schema_docs: DataFrame) -> DataFrame:
    """(fact_id, output_field, image): facts whose images lie in one group only; a small dimension."""
    exploded = schema_docs.select("fact_id", "output_field", F.explode("images").alias("image"), "groups")
    return exploded.filter(F.size(F.array_distinct("groups")) == 1).drop("groups")


def pinned(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """The file's row if its content has this hash, else an error."""
    row = spark.read.format("binaryFile").load(path).select("content", F.sha2("content", 256).alias("sha"))
    if row.filter(F.col("sha") != sha256).limit(1).count():
        raise ValueError(f"{path} is not the pinned version")
    return row


# --- sinks

def append(rows: DataFrame, path: str, kind: str = "json") -> None:
    rows.write.mode("append").format(kind).save(path)


def new_run(rows: DataFrame, path: str, run_id: str) -> str:
    """A run's output beside those before it; nothing is overwritten."""
    at = f"{path}/run={run_id}"
    rows.write.mode("errorifexists").parquet(at)
    return at


def per_case(rows: DataFrame, path: str, case: str = "case_id") -> None:
    """A JSON document for each case, in a folder of its own."""
    rows.select(case, F.to_json(F.struct(*[c for c in rows.columns if c != case])).alias("value")).write.mode("overwrite").partitionBy(case).text(path)


def pending(cases: DataFrame, done: DataFrame, key: str = "case_id") -> DataFrame:
    """What a resumed run still has to do."""
    return cases.join(done.select(key), key, "left_anti")


def changed(rows: DataFrame, stored: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The rows whose text differs from the stored one, by hash: an idempotent rewrite writes only these."""
    old = stored.select(*keys, F.sha2(text, 256).alias("_h"))
    return rows.withColumn("_h", F.sha2(text, 256)).join(old, [*keys, "_h"], "left_anti").drop("_h")


def fixed_width(rows: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Lines of a fixed-width report."""
    cells: list[Column] = [F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), w, " ") for c, w in widths.items()]
    return rows.select(F.concat(*cells).alias("value"))
