"""Labelled volumes: histograms, thresholds, intensity windows, nearest centres."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neighbours import nearest_of_many


def histogram(rows: DataFrame, keys: list[str], label: str, unit: float) -> DataFrame:
    """Voxels and volume of each label but the background, 0."""
    counts = rows.filter(F.col(label) != 0).groupBy(*keys, label).agg(F.count("*").alias("n_voxels"))
    return counts.withColumn("volume", F.round(F.col("n_voxels") * unit, 6))


def exact_percentiles(rows: DataFrame, value: str, shares: list[float], bins: int = 4096, bound: int = 1_000_000) -> list[float] | None:
    """Percentiles with linear interpolation, exact at any size: a histogram finds the bins that hold their ranks, and only those
    bins' values are sorted, or, if more than ``bound``, cut into bins again."""
    known = rows.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    n, low, high = known.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    places = [s * (n - 1) for s in shares]
    ranks = sorted({int(r) for p in places for r in (np.floor(p), np.ceil(p))})
    found = _order_statistics(known, ranks, 0, low, high, bins, bound)
    return [float(found[int(np.floor(p))] + (found[int(np.ceil(p))] - found[int(np.floor(p))]) * (p - np.floor(p))) for p in places]


def _order_statistics(known: DataFrame, ranks: list[int], before: int, low: float, high: float, bins: int, bound: int) -> dict[int, float]:
    """The values of the given ranks, all of which lie in [low, high]; ``before`` values lie below."""
    if low == high:
        return dict.fromkeys(ranks, low)
    inside = known.filter(F.col("v").between(low, high)).withColumn("b", F.least(F.floor((F.col("v") - low) / (high - low) * bins), F.lit(bins - 1)))
    counts = sorted((r.b, r.n, r.lo, r.hi) for r in inside.groupBy("b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect())  # a row a bin
    out: dict[int, float] = {}
    for b, n, lo, hi in counts:
        own = [r for r in ranks if before <= r < before + n]
        if own and (lo == hi or n > bound):
            out |= _order_statistics(known, own, before, lo, hi, bins, bound)
        elif own:
            values = sorted(r.v for r in inside.filter(F.col("b") == b).select("v").collect())  # ``bound`` at most
            out |= {r: values[r - before] for r in own}
        before += n
    return out


def percentile_window(rows: DataFrame, value: str, low: float = 0.01, high: float = 0.995, part: float = 0.1) -> DataFrame:
    """(low, high): percentiles of the foreground, as bounds for a 0..255 scale.

    Foreground is what exceeds the 1st percentile by ``part`` of the way to the 99.9th; if that is under 2 % of all, everything is.
    """
    spark = rows.sparkSession
    ends = exact_percentiles(rows, value, [0.01, 0.999])
    if ends is None:
        return spark.createDataFrame([(None, None)], "low double, high double")
    bright = rows.filter(F.col(value) > ends[0] + part * (ends[1] - ends[0]))
    n, all_ = bright.count(), rows.filter(F.col(value).isNotNull()).count()
    found = exact_percentiles(rows if n < 0.02 * all_ else bright, value, [low, high])
    return spark.createDataFrame([tuple(round(x, 6) for x in found)], "low double, high double")


def robust_ceiling(rows: DataFrame, label: str, value: str, least: int = 50, labels: int = 4, bone: Column | None = None, some: int = 200) -> DataFrame:
    """(ceiling, n_labels): 1.15 times the median, over labels of ``least`` voxels, of their 98th percentile, or, with fewer than
    ``labels`` such labels, the least of them; at most 2.5 times the bone's 99th percentile.

    Without labels it is 1.6 times the bone's, and without bone the 99.9th percentile of all.  Teeth and bone count from ``some``
    voxels on; ``bone`` tells the rows that are no tooth.
    """
    is_bone = F.coalesce(bone, F.lit(False)) if bone is not None else F.lit(False)
    whole = exact_percentiles(rows, value, [0.999])
    bones = rows.filter(is_bone)
    p99 = exact_percentiles(bones, value, [0.99])[0] if bones.count() >= some else None
    teeth = rows.filter(~is_bone & F.col(label).isNotNull())
    per = teeth.groupBy(label).agg(F.count("*").alias("n"), F.percentile(value, 0.98).alias("p"))
    found = per.agg(F.count_if(F.col("n") >= least).alias("k"), F.median(F.when(F.col("n") >= least, F.col("p"))).alias("m"), F.min(F.when(F.col("n") >= least, F.col("p"))).alias("low"), F.sum("n").alias("teeth"))
    cap = F.lit(2.5 * p99 if p99 is not None and p99 > 0 else None).cast("double")
    peak = F.when(F.col("teeth") >= some, F.when(F.col("k") >= labels, 1.15 * F.col("m")).when(F.col("k") > 0, 1.15 * F.col("low")))
    else_ = F.lit(1.6 * p99 if p99 is not None else whole[0] if whole else None).cast("double")
    return found.select(F.round(F.coalesce(F.when(peak.isNotNull(), F.least(peak, cap)), else_), 6).alias("ceiling"), F.col("k").alias("n_labels"))


def coverage(bone: Column, has_teeth: Column, present: Column, threshold: float = 500.0) -> Column:
    """Imaged if enough bone or any tooth is labelled; without volumes what is said, else null."""
    return F.when(bone.isNotNull(), (bone >= threshold) | has_teeth).otherwise(present)


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centre): the mean vector of each label."""
    items = rows.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("x"))
    return items.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))


def nearest(rows: DataFrame, key: str, vector: str, centres: DataFrame, label: str, bound: int = 10_000) -> DataFrame:
    """(key, nearest label, squared distance), of equally near labels the smallest.

    The centres are counted: up to ``bound`` of them go to every task, more are met in blocks by projection.
    """
    if centres.limit(bound + 1).count() > bound:
        return nearest_of_many(rows, key, vector, centres, label, "centre").select(key, "nearest", "d2")
    held = sorted((r[0], tuple(r[1])) for r in centres.select(label, "centre").collect())  # ``bound`` at most
    best = rows.select(key, _nearest_of(rows.sparkSession.sparkContext.broadcast(held), dict(centres.dtypes)[label])(vector).alias("b"))
    return best.select(key, F.col("b.l").alias("nearest"), F.col("b.d").alias("d2"))


def _nearest_of(held, kind: str):
    """struct (d, l): the least squared distance to the centres, and the first label that has it."""

    @F.pandas_udf(f"d double, l {kind}")
    def run(vectors: pd.Series) -> pd.DataFrame:
        labels = [x for x, _ in held.value]
        if not labels:
            return pd.DataFrame({"d": [None] * len(vectors), "l": [None] * len(vectors)})
        centres = np.array([c for _, c in held.value], np.float64)
        given = np.array([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), -1)
        d = np.full(len(given), np.inf)
        nth = np.zeros(len(given), np.int64)
        for k, c in enumerate(centres):  # one centre against the batch
            own = ((given - c) ** 2).sum(axis=1)
            nth[own < d] = k
            d = np.minimum(d, own)
        return pd.DataFrame({"d": d, "l": [labels[k] for k in nth.tolist()]})

    return run


def superior_axis(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """The axis in which two centres differ most, 0, 1 or 2."""
    gaps = [F.abs(x - y) for x, y in zip(a, b)]
    return F.array_max(F.array(*(F.struct(g.alias("g"), F.lit(-i).alias("i")) for i, g in enumerate(gaps))))["i"] * -1
