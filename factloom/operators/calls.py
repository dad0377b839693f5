"""Plans of questions: which facts are asked where, with which images, and what of the answers is worth telling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_meaningful


def applicable(scope: Column, position: Column) -> Column:
    """A fact without a scope is asked everywhere, any other at the positions of its scope."""
    return (F.size(F.coalesce(scope, F.array().cast("array<int>"))) == 0) | F.array_contains(scope, position)


def plan_errors(calls: DataFrame, facts: DataFrame) -> DataFrame:
    """(fact, error) of a plan (call, fact, images) over facts (fact, image): unknown facts, facts placed twice, facts placed nowhere,
    and facts whose image their call does not show.  Facts are distinct; a call that lists a fact twice places it twice."""
    known = facts.select("fact", "image")
    unknown = calls.join(known, "fact", "left_anti").select("fact").distinct().withColumn("error", F.lit("unknown"))
    twice = calls.groupBy("fact").agg(F.count("*").alias("n")).filter("n > 1").select("fact", F.lit("duplicate").alias("error"))
    nowhere = known.join(calls.select("fact"), "fact", "left_anti").select("fact", F.lit("unplaced").alias("error"))
    unseen = calls.join(known, "fact").filter(~F.array_contains("images", F.col("image"))).select("fact").distinct().withColumn("error", F.lit("image_mismatch"))
    return unknown.unionByName(twice).unionByName(nowhere).unionByName(unseen)


def with_images(calls: DataFrame, images: DataFrame) -> DataFrame:
    """Calls (case_id, call, images) with the paths of their images (case_id, image_key, path), and how many are missing."""
    wanted = calls.select("case_id", "call", F.explode_outer("images").alias("image_key"))
    met = wanted.join(images.select("case_id", "image_key", "path"), ["case_id", "image_key"], "left")
    return met.groupBy("case_id", "call").agg(F.array_sort(F.collect_list("path")).alias("paths"), F.count_if(F.col("path").isNull() & F.col("image_key").isNotNull()).alias("n_missing"))


def abnormal(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, value): only what is not normal, one row for each such answer."""
    said = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    return rows.select(*keys, F.inline(said)).filter(is_meaningful(F.col("value")))


def coverage_sets(rows: DataFrame, by: list[str], position: str, answer: str) -> DataFrame:
    """The positions at which something was answered."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_set(F.when(F.col(answer).isNotNull(), F.col(position)))).alias("covered"))


def toothless(absent: Column, remnants: Column) -> Column:
    """Missing positions without those where a root is left."""
    none = F.array().cast("array<int>")
    return F.array_except(F.coalesce(absent, none), F.coalesce(remnants, none))


def unlocated(entries: Column) -> Column:
    """The entries (fdi, location) that tell a place but no position."""
    return F.filter(entries, lambda e: e["fdi"].isNull() & (F.coalesce(F.trim(e["location"]), F.lit("")) != ""))


def dig(document: Column, path: str, side: str = "") -> Column:
    """What a JSON document holds at a path such as ``canals.{side}.location``; null if any step is missing."""
    return F.get_json_object(document, "$." + path.replace("{side}", side))
