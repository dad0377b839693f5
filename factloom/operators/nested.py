"""Nested documents as rows of paths and back: meeting two readings of one document value by value."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settled

STEP = "struct<name:string,at:int>"
_AT_ONCE = 4  # levels to a pass


def walked(docs: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path, kind, value, written): every leaf of every document (a variant), its path of steps (a name or an array's place) from the root.

    ``value`` is JSON text.  Empty objects and arrays are leaves of kind object or array, so nothing is lost; nulls are leaves too.
    A pass goes down four levels row by row, without a shuffle, and is followed by another only if something is nested still, whatever the
    documents' shapes; they are never gathered.
    """
    level = docs.select(F.col(key).alias("_k"), F.lit("").alias("written"), F.col(document).alias("v")).filter("v IS NOT NULL")
    kind = F.when(F.col("_t").startswith("OBJECT"), "object").when(F.col("_t").startswith("ARRAY"), "array").otherwise("leaf")
    while True:
        for _ in range(_AT_ONCE):
            below = level.lateralJoin(level.sparkSession.tvf.variant_explode_outer(F.col("v").outer()))
            step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), _escaped(F.col("key")))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string")))
            inner = F.col("pos").isNotNull()  # leaves, and what is empty, stay as they are
            longer = F.when(F.col("written") == "", step).otherwise(F.concat("written", F.lit("\n"), step))
            level = below.select("_k", F.when(inner, longer).otherwise(F.col("written")).alias("written"), F.when(inner, F.col("value")).otherwise(F.col("v")).alias("v"))
        typed = level.withColumns({"_t": F.schema_of_variant("v"), "value": F.to_json("v")})
        if typed.filter((kind != "leaf") & ~F.col("value").isin("{}", "[]")).isEmpty():
            return typed.select(F.col("_k").alias(key), _read_back(F.col("written")).alias("path"), kind.alias("kind"), "value", "written")
        level = settled(level)


def _escaped(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def _written(path: Column) -> Column:
    """A path as one string that tells its steps apart: a name behind a dot, a place behind a bracket, a line each."""
    return F.array_join(F.transform(path, lambda s: F.when(s["name"].isNotNull(), F.concat(F.lit("."), _escaped(s["name"]))).otherwise(F.concat(F.lit("["), s["at"].cast("string")))), "\n")


def _read_back(written: Column) -> Column:
    name = lambda t: F.replace(F.replace(t, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))
    steps = F.filter(F.split(written, "\n"), lambda t: t != "")
    return F.transform(steps, lambda t: F.struct(F.when(t.startswith("."), name(F.substring(t, 2, 1 << 30))).alias("name"), F.when(t.startswith("["), F.substring(t, 2, 20)).cast("int").alias("at"))).cast(f"array<{STEP}>")


def _folded(paths, values) -> str:
    """The JSON text of one document from the written paths of its leaves; a place with something below it is nested."""
    tree: dict = {}
    for path, value in zip(paths, values):
        node, last = tree, ""
        for step in path.split("\n") if path else ():
            if not isinstance(node.get(last), dict):
                node[last] = {}
            node, last = node[last], step
        if not isinstance(node.get(last), dict):
            node[last] = value

    def text(node) -> str:
        if isinstance(node, str):
            return node
        names = sorted((k[1:].replace("\\n", "\n").replace("\\b", "\\"), k) for k in node if k[0] == ".")
        if names:
            return "{" + ",".join(json.dumps(n, ensure_ascii=False) + ":" + text(node[k]) for n, k in names) + "}"
        return "[" + ",".join(text(node[k]) for k in sorted(node, key=lambda k: int(k[1:]))) + "]"

    return text(tree[""])


def _gathered(leaves: DataFrame, key: str, name: str) -> DataFrame:
    """(_k, name_paths, name_values): the leaves of a document, which was one row before; null if there are none."""
    written = F.col("written") if "written" in leaves.columns else _written(F.col("path"))
    leaf = F.struct(written.alias("p"), F.coalesce("value", F.lit("null")).alias("v"))
    held = leaves.groupBy(F.col(key).alias("_k")).agg(F.collect_list(leaf).alias("m"))
    return held.select("_k", F.col("m.p").alias(f"{name}_paths"), F.col("m.v").alias(f"{name}_values"))


def rebuilt(leaves: DataFrame, key: str) -> DataFrame:
    """(key, document): the JSON text of the documents of ``walked`` rows, object members by name; a document's leaves meet once."""
    @F.pandas_udf("string")
    def folded(paths: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([_folded(p, v) for p, v in zip(paths, values)], dtype=object)

    return _gathered(leaves, key, "a").select(F.col("_k").alias(key), folded("a_paths", "a_values").alias("document"))


def path_text(path: Column, places: bool = True) -> Column:
    """A path written out, as in ``lines[2].flag``; without ``places`` as in ``lines[].flag``."""
    step = lambda s: F.when(s["name"].isNotNull(), F.concat(F.lit("."), s["name"])).otherwise(F.concat(F.lit("["), s["at"].cast("string") if places else F.lit(""), F.lit("]")))
    return F.ltrim(F.array_join(F.transform(path, step), ""), F.lit("."))


def met(a: DataFrame, b: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path, kind, a, b, agreed): two readings of each document, path by path; a path that only one of them has meets null.

    ``agreed`` is the value both give; where they differ it is null and ``differs`` tells so.
    """
    x, y = (walked(d, key, document).select(key, F.col("written").alias("_p"), F.col("kind").alias(f"k{n}"), F.col("value").alias(n)) for d, n in ((a, "a"), (b, "b")))
    same = F.col("a").eqNullSafe(F.col("b"))
    return x.join(y, [key, "_p"], "full_outer").select(key, _read_back(F.col("_p")).alias("path"), F.coalesce("ka", "kb").alias("kind"), "a", "b", F.when(same, F.col("a")).alias("agreed"), (~same).alias("differs"))


def agreed_documents(a: DataFrame, b: DataFrame, key: str, document: str) -> DataFrame:
    """(key, document): each document with null in every place where the two readings differ; what is nested in one stays nested.

    The readings of a document meet by its key, each with its leaves, so leaves are not shuffled by their paths.
    """
    @F.pandas_udf("string")
    def folded(a_paths: pd.Series, a_values: pd.Series, b_paths: pd.Series, b_values: pd.Series) -> pd.Series:
        out = []
        for p, v, q, w in zip(a_paths, a_values, b_paths, b_values):
            one, two = ({} if m is None else dict(zip(m, n)) for m, n in ((p, v), (q, w)))
            out.append(_folded(one | two, [x if x == two.get(m) else "null" for m, x in (one | {m: None for m in two if m not in one}).items()]))
        return pd.Series(out, dtype=object)

    x, y = (_gathered(walked(d, key, document), key, n) for d, n in ((a, "a"), (b, "b")))
    return x.join(y, "_k", "full_outer").select(F.col("_k").alias(key), folded("a_paths", "a_values", "b_paths", "b_values").alias("document"))
