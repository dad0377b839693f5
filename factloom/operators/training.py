"""Training sets: reasons for masking, class caps, hold-outs, leak guards.

Random picks are orders by md5(seed | key): the same on every machine, whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def pick_order(seed: str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def mask_reason(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that holds; null if the value is supervised."""
    out = None
    for name, condition in checks:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out


def position_checks(evidence: Column, prose: Column, refused: Column, unstated: Column, null: Column, gated: Column) -> list[tuple[str, Column]]:
    """The order for positions: null before the gate."""
    return [("no_evidence", evidence), ("prose", prose), ("refused", refused), ("unstated", unstated), ("null", null), ("gated", gated)]


def arch_checks(evidence: Column, prose: Column, refused: Column, gated: Column, null: Column) -> list[tuple[str, Column]]:
    """The order for whole arches: the gate before null."""
    return [("no_evidence", evidence), ("prose", prose), ("refused", refused), ("gated", gated), ("null", null)]


def negative_cap(rows: DataFrame, by: list[str], positive: Column, key: str, cap: float, seed: str) -> DataFrame:
    """All positives and, of each group, floor(cap * positives) negatives at most; groups without positives lose all.

    The negatives are those least in the pick order.  A histogram of the order's first four digits tells where a group's cut
    falls; only the rows of that one cell, a 65,536th of the group, are ranked.
    """
    marked = rows.withColumn("_pos", positive.cast("int")).withColumn("_cell", F.conv(F.substring(pick_order(seed, F.col(key)), 1, 4), 16, 10).cast("int"))
    cells = marked.groupBy(*by, "_cell").agg(F.sum("_pos").alias("_n"), F.sum(1 - F.col("_pos")).alias("_neg"))
    most = F.floor(F.lit(cap) * F.sum("_n").over(W.partitionBy(*by)))
    upto = F.sum("_neg").over(W.partitionBy(*by).orderBy("_cell"))
    borders = cells.select(*by, "_cell", most.alias("_most"), upto.alias("_upto"), (upto - F.col("_neg")).alias("_below"))
    # the last cell that is taken whole, and what is still to be taken from the next one
    cut = borders.groupBy(*by).agg(F.max("_most").alias("_most"), F.max(F.when(F.col("_upto") <= F.col("_most"), F.col("_cell"))).alias("_whole"), F.min(F.when(F.col("_upto") > F.col("_most"), F.struct("_cell", "_below"))).alias("_next"))
    met = marked.join(cut, by).filter(F.col("_most") > 0)
    whole = met.filter((F.col("_pos") == 1) | (F.col("_cell") <= F.col("_whole")))
    border = met.filter((F.col("_pos") == 0) & (F.col("_cell") == F.col("_next._cell")))
    ranked = border.withColumn("_at", F.row_number().over(W.partitionBy(*by).orderBy(pick_order(seed, F.col(key)), key)))
    return whole.select(rows.columns).unionByName(ranked.filter(F.col("_at") <= F.col("_most") - F.col("_next._below")).select(rows.columns))


def holdout(rows: DataFrame, by: list[str], key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows of each stratum, fewer where it has fewer."""
    ranked = rows.withColumn("_at", F.row_number().over(W.partitionBy(*by).orderBy(pick_order(seed, F.col(key)), key)))
    return ranked.filter(F.col("_at") <= n).drop("_at")


def without(rows: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """The rows that are not held out."""
    return rows.join(held.select(key), key, "left_anti")


def leaks(train: DataFrame, held: DataFrame, key: str) -> DataFrame:
    return train.join(held.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n_leaks"))


def composition(rows: DataFrame, text: str) -> DataFrame:
    return rows.groupBy(F.substring(text, 1, 1).alias("prefix")).agg(F.count("*").alias("n"))


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def mask_crosstab(rows: DataFrame, by: list[str], reason: Column, positive: Column, prefix: Column) -> DataFrame:
    """Per ``by`` and reason: rows, distinct prefixes, and positives among them."""
    marked = rows.withColumns({"reason": reason, "_prefix": prefix, "_pos": F.coalesce(positive.cast("long"), F.lit(0))})
    # two steps, each with partial sums: distinct prefixes need no row of their own beyond one a prefix
    per = marked.groupBy(*by, "reason", "_prefix").agg(F.count("*").alias("n"), F.sum("_pos").alias("p"))
    return per.groupBy(*by, "reason").agg(F.sum("n").alias("n"), F.count("_prefix").alias("n_prefixes"), F.sum("p").alias("n_positive"))
