"""Overlapping windows of class scores blended into one class for each place."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gaussian(size: int, share: float = 0.125) -> list[float]:
    """Weights of a window's places: highest in its middle, with a deviation of ``share`` of its size."""
    mid, deviation = (size - 1) / 2, size * share
    return [math.exp(-0.5 * ((i - mid) / deviation) ** 2) for i in range(size)]


def blended_argmax(tiles: DataFrame, keys: list[str], start: str, label: str, score: str, weights: list[float], digits: int = 9) -> DataFrame:
    """(keys, at, label, score, coverage): of every place the class with the greatest weighted mean score over all windows that hold it.

    A window's row is spread over its places only; sums are taken before the shuffle, and the class is picked by ``max_by`` over the
    few sums of a place.  Scores that agree to ``digits`` are equal, and then the least class wins.
    """
    each = tiles.select(*keys, label, score, start, F.posexplode(F.array(*map(F.lit, weights))).alias("_i", "_w")).withColumn("at", F.col(start) + F.col("_i"))
    sums = each.groupBy(*keys, "at", label).agg(F.sum(F.col(score) * F.col("_w")).alias("_s"), F.sum("_w").alias("_w"))
    mean = F.round(F.col("_s") / F.col("_w"), digits)
    best = sums.withColumn("_m", mean).groupBy(*keys, "at").agg(F.max("_m").alias("score"), F.min_by(label, F.struct(-F.col("_m"), F.col(label))).alias(label), F.sum("_w").alias("coverage"))
    return best.select(*keys, "at", label, "score", "coverage")
