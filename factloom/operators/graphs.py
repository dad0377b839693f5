"""Connected components of edges, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settled


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the least node reachable, for every node of an edge; nodes are of any type with an order.

    Neighbours are hung on the least node around them, first those above a node, then those below it, until nothing moves; rounds
    are as many as the logarithm of the longest path, and a round's rows no more than the edges.
    """
    def hung(rows: DataFrame, both_ways: bool) -> DataFrame:
        seen = rows.select(F.col("x").alias("n"), F.col("y").alias("m"))
        if both_ways:
            seen = seen.unionAll(rows.select(F.col("y").alias("n"), F.col("x").alias("m")))
        least = seen.groupBy("n").agg(F.min("m").alias("low")).withColumn("low", F.least("n", "low"))
        met = seen.join(least, "n")
        if both_ways:
            return met.filter("m > n").select(F.col("m").alias("x"), F.col("low").alias("y")).distinct()
        down = met.filter("m <> low").select(F.col("m").alias("x"), F.col("low").alias("y"))
        return down.unionAll(least.select(F.col("n").alias("x"), F.col("low").alias("y"))).distinct()

    def digest(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y"))).first())

    rows = settled(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct())
    before = None
    while before != (before := digest(rows)):
        rows = settled(hung(hung(rows, True), False))
    return rows.select(F.col("x").alias("node"), F.col("y").alias("label")).unionAll(rows.select(F.col("y").alias("node"), F.col("y").alias("label")).distinct())
