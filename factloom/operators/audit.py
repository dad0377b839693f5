"""Audits: each screen is one query of findings (screen, level, key, message); a run is their union, the gate counts errors."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR, NOTE = "ERROR", "NOTE"


def screen(rows: DataFrame, name: str, level: str, failing: Column, key: str, message: Column, masked: Column | None = None) -> DataFrame:
    """The failing rows; masked claims are notes, whatever the level."""
    graded = F.lit(level) if masked is None else F.when(masked, NOTE).otherwise(level)
    return rows.filter(failing).select(F.lit(name).alias("screen"), graded.alias("level"), F.col(key).cast("string").alias("key"), message.alias("message"))


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent: str, name: str, level: str = ERROR) -> DataFrame:
    """Rows whose parent is missing."""
    missing = rows.join(parents.select(F.col(parent).alias("_p")).distinct(), F.col(key) == F.col("_p"), "left_anti")
    return screen(missing, name, level, F.lit(True), key, F.lit("parent is missing"))


def findings(screens: Iterable[DataFrame]) -> DataFrame:
    out = None
    for s in screens:
        out = s if out is None else out.unionByName(s)
    if out is None:
        raise ValueError("no screens")
    return out


def error_cases(found: DataFrame) -> DataFrame:
    return found.filter(F.col("level") == ERROR).select("key").distinct()


def gate(found: DataFrame) -> None:
    n = found.filter(F.col("level") == ERROR).count()
    if n:
        raise ValueError(f"{n} errors")
