"""Readings made clean, with counts of what was dropped or mended taken in the same pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

ARCH_QUADRANTS = {"maxilla": (1, 2), "mandible": (3, 4)}


def arch_readings(rows: DataFrame, keys: list[str], arch: str, readings: str, allowed: list[str], aliases: dict[str, str] | None = None, name: str = "readings") -> tuple[DataFrame, Observation]:
    """(keys, arch, fdi, answer) of maps from a position's text to an answer, and the counts of one pass over them.

    A key that is no position of two digits goes (``malformed``), as does one of the other arch (``stray``).  Answers are trimmed, in
    lower case and under their usual name; one that is not ``allowed`` becomes "unreadable" and its tooth stays.  The observation has
    ``read``, ``malformed``, ``stray`` and ``unreadable`` once the rows have been used by an action.
    """
    each = rows.select(*keys, arch, F.explode(readings).alias("_k", "_v"))
    fdi = F.when(F.trim("_k").rlike("^[1-4][1-8]$"), F.trim("_k").cast("int"))
    said = F.lower(F.trim("_v"))
    for other, usual in (aliases or {}).items():
        said = F.when(said == other, F.lit(usual)).otherwise(said)
    quadrant = F.floor(F.col("fdi") / 10)
    of_arch = F.coalesce(*(F.when(F.col(arch) == a, quadrant.isin(*q)) for a, q in ARCH_QUADRANTS.items()), F.lit(False))
    marked = each.withColumns({"fdi": fdi, "answer": said}).withColumn("answer", F.when(F.col("answer").isin(*allowed), F.col("answer")).otherwise("unreadable"))
    good = F.col("fdi").isNotNull() & of_arch
    seen = Observation(name)
    counts = {"read": F.lit(True), "malformed": F.col("fdi").isNull(), "stray": F.col("fdi").isNotNull() & ~of_arch, "unreadable": good & (F.col("answer") == "unreadable")}
    observed = marked.observe(seen, *(F.count_if(c).alias(k) for k, c in counts.items()))
    return observed.filter(good).select(*keys, arch, "fdi", "answer"), seen


def without_excluded(facts: DataFrame, readings: DataFrame, keys: list[str], excluded: Column, bone: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of cases whose upper arch is excluded from the images: bone facts become null and upper teeth's readings go; other facts stay."""
    marked = facts.withColumn("_out", F.coalesce(excluded, F.lit(False)))
    out = marked.filter("_out").select(*keys).distinct()
    upper = readings.join(out.withColumn("_u", F.lit(True)), keys, "left").filter(~(F.coalesce(F.col("_u"), F.lit(False)) & (F.col("fdi") < 30))).drop("_u")
    return marked.withColumns({c: F.when(~F.col("_out"), F.col(c)) for c in bone}).drop("_out"), upper


def normalised(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Each position once for its case and arch, with its first answer in the order of the alphabet that can be read."""
    rank = F.struct((F.col("answer") == "unreadable").alias("u"), F.col("answer").alias("answer"))
    return readings.groupBy(*keys, "arch", "fdi").agg(F.min(rank).alias("r")).select(*keys, "arch", "fdi", "r.answer")


def changed_by(rows: DataFrame, step) -> DataFrame:
    """(side, n): rows that a step takes away or brings; none, if it leaves its input as it is (a fixed point)."""
    after = step(rows).select(*rows.columns)
    gone = rows.exceptAll(after).select(F.lit("gone").alias("side"))
    new = after.exceptAll(rows).select(F.lit("new").alias("side"))
    sides = rows.sparkSession.createDataFrame([("gone",), ("new",)], "side string")
    return sides.join(gone.unionAll(new).groupBy("side").agg(F.count("*").alias("n")), "side", "left").select("side", F.coalesce("n", F.lit(0)).alias("n"))
