"""Reconciling claims: votes between sources, majorities, agreement, folds of answers that may be missing.

An answer is true, false or null, and null (not answered) is neither of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

AGREE, DENY, ABSTAIN = "agree", "deny", "abstain"


def verdict(answer: Column) -> Column:
    """A three-valued answer as a vote."""
    return F.when(answer, AGREE).when(~answer, DENY).otherwise(ABSTAIN)


def reconcile(votes: DataFrame, keys: list[str], vote: str = "verdict", rule: str = "majority") -> DataFrame:
    """One row per key: votes for and against, and whether the claim is kept or dropped.

    ``unanimous`` keeps a claim that nobody denies, ``majority`` one with more votes for than against, so a tie dies.
    A claim without a vote for it is neither kept nor dropped.
    """
    counted = votes.groupBy(*keys).agg(F.count_if(F.col(vote) == AGREE).alias("n_agree"), F.count_if(F.col(vote) == DENY).alias("n_deny"))
    stands = F.col("n_deny") == 0 if rule == "unanimous" else F.col("n_agree") > F.col("n_deny")
    claimed = F.col("n_agree") > 0
    return counted.withColumn("kept", claimed & stands).withColumn("dropped", claimed & ~stands)


def majority_first_seen(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each key, of equally frequent ones the first seen, of those seen together the greatest; with its
    share of the answers.

    Nulls are no answers.  Two aggregations with partial sums; no key's rows meet in one task.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    best = F.max_by(F.col(value), F.struct(F.col("n"), -F.col("seen"), F.col(value)))
    return counts.groupBy(*keys).agg(best.alias("majority"), (F.max("n") / F.sum("n")).alias("agreement"))


def union_lists(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(item)).alias("items"))


def presence(rows: DataFrame, keys: list[str], present: Column, absent: Column) -> DataFrame:
    """Present if at least as many readers say so as say the opposite; null if nobody says either."""
    c = rows.groupBy(*keys).agg(F.count_if(present).alias("n_present"), F.count_if(absent).alias("n_absent"))
    return c.withColumn("present", F.when(F.col("n_present") + F.col("n_absent") > 0, F.col("n_present") >= F.col("n_absent")))


def side_majority(rows: DataFrame, keys: list[str], value: str, a: str, b: str) -> DataFrame:
    """``a`` or ``b``, whichever has more votes; null on a tie."""
    c = rows.groupBy(*keys).agg(F.count_if(F.col(value) == a).alias("na"), F.count_if(F.col(value) == b).alias("nb"))
    return c.select(*keys, F.when(F.col("na") > F.col("nb"), F.lit(a)).when(F.col("nb") > F.col("na"), F.lit(b)).alias("side"))


def unanimous_or(value: str, prior: str) -> Column:
    """An aggregate: the only value given, else the prior."""
    return F.when(F.min(value) == F.max(value), F.min(value)).otherwise(F.lit(prior))


def any_false_wins(value: str) -> Column:
    """An aggregate: false if anyone says false, true if anyone says true, null if all are silent."""
    return F.when(F.count_if(~F.col(value)) > 0, F.lit(False)).when(F.count_if(F.col(value)) > 0, F.lit(True))


def priority_pick(rows: DataFrame, keys: list[str], value: str, priority: str, unspecified: str = "unspecified") -> DataFrame:
    """The value of the foremost source that says something."""
    said = rows.filter(F.col(value).isNotNull() & (F.col(value) != unspecified))
    return said.groupBy(*keys).agg(F.min_by(value, priority).alias("picked"))


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key (first wins; descending order for last wins)."""
    columns = rows.columns
    ranked = rows.withColumn("_at", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_at = 1").select(*columns)


def null_disagreement(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two readings joined: a value both give alike stays, any other becomes null, ``differs`` tells which."""
    x, y = a.select(*keys, F.col(value).alias("_x")), b.select(*keys, F.col(value).alias("_y"))
    same = F.col("_x").eqNullSafe(F.col("_y"))
    return x.join(y, keys, "full_outer").select(*keys, F.when(same, F.col("_x")).alias(value), (~same).alias("differs"))


def quadrant_pattern(counts: DataFrame, n_sets: Column, n_full: Column, n_answers: Column, total: Column) -> Column:
    """A ladder over coverage, first match wins: unknown, none, complete, single, partial, scatter."""
    return F.when(n_answers == 0, "unknown").when(n_sets == 0, "none").when(n_full == total, "complete").when(n_sets == 1, "single").when(n_full >= 1, "partial").otherwise("scatter")
