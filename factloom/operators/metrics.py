"""Scoring: claim sets against truth, per-field surveys, means, corpus BLEU and the light METEOR."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 over nothing."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def score_sets(claims: DataFrame, truth: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Counts of true and false positives and false negatives over sets of keys, with precision, recall and F1, per ``by``.

    Every row is tagged by its side and the sides are met by one aggregation: it shuffles once, keeps no order and, unlike a
    full outer join, leaves no partition that AQE cannot split.
    """
    both = claims.select(*keys, F.lit(1).alias("_c"), F.lit(0).alias("_t")).unionByName(truth.select(*keys, F.lit(0).alias("_c"), F.lit(1).alias("_t")))
    met = both.groupBy(*keys).agg(F.max("_c").alias("_c"), F.max("_t").alias("_t"))
    counts = met.groupBy(*by).agg(F.sum(F.col("_c") * F.col("_t")).alias("tp"), F.sum(F.col("_c") * (1 - F.col("_t"))).alias("fp"), F.sum((1 - F.col("_c")) * F.col("_t")).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(*by, "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"))


def survey(answers: DataFrame, field: str, predicted: str, true: str) -> DataFrame:
    """Per yes/no field, over positions both sides answer: true positives, false ones, misses.

    Agreed negatives count nowhere, so a field with nothing but those has no row: it says nothing about the field.
    """
    both = answers.filter(F.col(predicted).isNotNull() & F.col(true).isNotNull())
    p, t = F.col(predicted), F.col(true)
    counts = both.groupBy(field).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    return counts.filter("tp + fp + fn > 0")


def mean_sd(value: str) -> tuple[Column, Column]:
    """Mean and sample deviation of what is not null; 0 of one value or none."""
    return F.coalesce(F.avg(value), F.lit(0.0)), F.coalesce(F.stddev_samp(value), F.lit(0.0))


def harmonic(a: Column, b: Column) -> Column:
    return F.when(a + b == 0, F.lit(0.0)).otherwise(2 * a * b / (a + b))


def final_score(clinical: Column, bleu: Column, meteor: Column) -> Column:
    return 0.8 * clinical + 0.2 * (bleu + meteor) / 2


def ngram_counts(candidate: Sequence[str], references: Sequence[Sequence[str]], order: int = 4) -> tuple[list[int], list[int], int, int]:
    """(clipped hits, n-grams) by n, the candidate's length and that of its closest reference, of equally close ones the shorter.

    A candidate's n-gram counts are clipped by the most any of its references has; only n-grams of the references are counted.
    """
    hits, sizes = [], []
    for n in range(1, order + 1):
        most = _reference_counts(tuple(map(tuple, references)), n)
        found = Counter(g for g in zip(*(candidate[k:] for k in range(n))) if g in most)
        hits.append(sum(min(c, most[g]) for g, c in found.items()))
        sizes.append(max(0, len(candidate) - n + 1))
    near = min((abs(len(r) - len(candidate)), len(r)) for r in references)[1] if references else 0
    return hits, sizes, len(candidate), near


@lru_cache(maxsize=4096)
def _reference_counts(references: tuple[tuple[str, ...], ...], n: int) -> dict[tuple[str, ...], int]:
    most: dict[tuple[str, ...], int] = {}
    for r in references:
        for g, c in Counter(zip(*(r[k:] for k in range(n)))).items():
            most[g] = max(c, most.get(g, 0))
    return most


def bleu_of(rows: DataFrame, by: list[str], candidate: str, references: str, order: int = 4) -> DataFrame:
    """BLEU of uniform weights per ``by`` (corpus BLEU: sums first), of rows with a candidate and all its references, as token arrays.

    No unigram in common gives 0; a higher order with none counts 0.1 in its place.  The n-grams of a row are counted where
    the row is; only its sums are shuffled.
    """

    @F.pandas_udf("array<long>")
    def counted(c: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for one, several in zip(c, r):
            hits, sizes, length, near = ngram_counts(list(one), list(several), order)
            out.append([*hits, *sizes, length, near])
        return pd.Series(out, index=c.index, dtype="object")

    names = [*(f"n{n}" for n in range(1, order + 1)), *(f"d{n}" for n in range(1, order + 1)), "c_len", "r_len"]
    per = rows.select(*by, counted(candidate, references).alias("_n"))
    out = per.groupBy(*by).agg(*(F.sum(F.col("_n")[i]).alias(name) for i, name in enumerate(names)))
    logs = sum((F.log(F.when(F.col(f"n{n}") == 0, F.lit(0.1)).otherwise(F.col(f"n{n}")) / F.greatest(F.col(f"d{n}"), F.lit(1))) for n in range(1, order + 1)), F.lit(0.0))
    penalty = F.when(F.col("c_len") > F.col("r_len"), F.lit(1.0)).otherwise(F.exp(1 - F.col("r_len") / F.col("c_len")))
    score = F.when(F.col("n1") == 0, F.lit(0.0)).otherwise(penalty * F.exp(logs / order))
    return out.select(*by, F.round(score, 6).alias("bleu"))


def bleu(pairs: DataFrame, by: list[str], key: str, candidate: str, reference: str, order: int = 4) -> DataFrame:
    """The same of rows for each pair of a candidate (``key``) and a reference: a candidate's rows meet first."""
    one = pairs.groupBy(*by, key).agg(F.first(candidate).alias("_cand"), F.collect_set(reference).alias("_refs"))
    return bleu_of(one, by, "_cand", "_refs", order)


def meteor_score(candidate: Sequence[str], reference: Sequence[str]) -> float:
    """The light METEOR: exact matches, the k-th occurrence of a word with the k-th; F = 10PR / (R + 9P), less half the cube of
    chunks per match.  Two empty texts agree fully, one empty text not at all."""
    if not len(candidate) or not len(reference):
        return 1.0 if len(candidate) == len(reference) else 0.0
    places: dict[str, list[int]] = {}
    for j in range(len(reference) - 1, -1, -1):
        places.setdefault(reference[j], []).append(j)
    matches = chunks = 0
    last = (-2, -2)
    for i, token in enumerate(candidate):
        if left := places.get(token):
            at = (i, left.pop())
            chunks += at != (last[0] + 1, last[1] + 1)
            matches += 1
            last = at
    if not matches:
        return 0.0
    p, r = matches / len(candidate), matches / len(reference)
    return 10 * p * r / (r + 9 * p) * (1 - 0.5 * (chunks / matches) ** 3)


def meteor_lite(pairs: DataFrame, keys: list[str], candidate: str, reference: str) -> DataFrame:
    """(keys, meteor) of each pair of token arrays, row by row: nothing is shuffled."""

    @F.pandas_udf("double")
    def score(c: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([meteor_score(list(x), list(y)) for x, y in zip(c, r)], index=c.index, dtype="float64")

    return pairs.select(*keys, F.round(score(candidate, reference), 6).alias("meteor"))


# --- fields of any kind, and runs over cases

ITEM_KEYS = ("fdi", "fdi_number", "tooth", "position")  # fixed values: what names an item, the first that is given


def item_key(item: Column) -> Column:
    """What an item (a map of strings) is known by: its position, else its span, whichever way round, else all it holds."""
    start, end = item["span_start"].try_cast("int"), item["span_end"].try_cast("int")
    span = F.when(start.isNotNull() & end.isNotNull(), F.concat_ws("-", F.least(start, end), F.greatest(start, end)))
    whole = F.array_join(F.transform(F.array_sort(F.map_entries(item)), lambda e: F.concat_ws("=", e["key"], e["value"])), "|")
    return F.coalesce(*(item[k] for k in ITEM_KEYS), span, whole)


def _folded(value: Column) -> Column:
    return F.lower(F.trim(value))


def score_kinds(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per field and its kind the counts that the kind has: tp, fp, fn of flags and lists, scored and right of maps and enums.

    ``rows``: by, kind, and both sides of each kind: claimed_flag/true_flag, claimed_list/true_list (arrays of keys), claimed_map/
    true_map, claimed_text/true_text.  Only answers both sides give count; agreed negatives count nowhere, a map is scored on
    the truth's keys that the claim has, and a field whose counts are all zero has no row.
    """
    kind = F.col("kind")
    c, t = F.col("claimed_flag"), F.col("true_flag")
    both = c.isNotNull() & t.isNotNull()
    claimed, true = F.array_distinct("claimed_list"), F.array_distinct("true_list")
    shared = F.size(F.array_intersect(claimed, true))
    lists = (kind == "list") & claimed.isNotNull() & true.isNotNull()
    keys = F.filter(F.map_keys("true_map"), lambda k: F.col("claimed_map")[k].isNotNull())
    maps = (kind == "map") & F.col("claimed_map").isNotNull() & F.col("true_map").isNotNull()
    agreeing = F.size(F.filter(keys, lambda k: _folded(F.col("claimed_map")[k]) == _folded(F.col("true_map")[k])))
    enums = (kind == "enum") & F.col("claimed_text").isNotNull() & F.col("true_text").isNotNull()
    flags = (kind == "bool") & both
    n = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    counts = rows.groupBy(*by, "kind").agg(
        n(F.when(flags, (c & t).cast("int")).when(lists, shared)).alias("tp"),
        n(F.when(flags, (c & ~t).cast("int")).when(lists, F.size(claimed) - shared)).alias("fp"),
        n(F.when(flags, (~c & t).cast("int")).when(lists, F.size(true) - shared)).alias("fn"),
        n(F.when(maps, F.size(keys)).when(enums, 1)).alias("scored"),
        n(F.when(maps, agreeing).when(enums, (_folded(F.col("claimed_text")) == _folded(F.col("true_text"))).cast("int"))).alias("right"),
    )
    return counts.filter("tp + fp + fn + scored > 0")


def case_stats(rows: DataFrame, by: list[str], always: tuple[str, ...], clinical: tuple[str, ...]) -> DataFrame:
    """Mean and deviation of each metric over cases; the clinical ones are null where no case has the last of them."""
    some = F.count(clinical[-1]) > 0
    out = []
    for name in (*always, *clinical):
        mean, sd = mean_sd(name)
        if name in clinical:
            known = F.when(F.col(clinical[-1]).isNotNull(), F.col(name))
            mean, sd = (F.when(some, x) for x in (F.coalesce(F.avg(known), F.lit(0.0)), F.coalesce(F.stddev_samp(known), F.lit(0.0))))
        out += [F.round(mean, 6).alias(f"{name}_mean"), F.round(sd, 6).alias(f"{name}_sd")]
    return rows.groupBy(*by).agg(*out)


def action_counts(rows: DataFrame, action: str) -> DataFrame:
    """How often each repair was made, the most frequent first, equally frequent ones by name."""
    return rows.groupBy(action).agg(F.count("*").alias("n")).orderBy(F.desc("n"), action)
