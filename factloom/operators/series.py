"""Ordered rows: runs, gaps, interpolation, curves, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def islands(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Runs of consecutive integers of each key: (keys, first, last, length)."""
    distinct = rows.select(*keys, at).distinct()
    group = distinct.withColumn("_g", F.col(at) - F.row_number().over(W.partitionBy(*keys).orderBy(at)))
    return group.groupBy(*keys, "_g").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("length")).drop("_g")


def longest_run(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    return islands(rows, keys, at).groupBy(*keys).agg(F.max("length").alias("longest_run"))


def is_consecutive(values: Column) -> Column:
    """Whether distinct integers leave no gap; fewer than two never do."""
    return (F.size(values) < 2) | (F.array_max(values) - F.array_min(values) + 1 == F.size(F.array_distinct(values)))


def interpolate(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Missing values on the line between their neighbours, beyond the ends on that of the two nearest; a key with fewer than two
    values is left as it is."""
    order = W.partitionBy(*keys).orderBy(at)
    back, on = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("x"), F.col(value).alias("y")))
    known = rows.withColumn("_p", point).withColumn("_l1", F.last("_p", True).over(back)).withColumn("_r1", F.first("_p", True).over(on))
    # a point with the one behind it, carried to where the point is the nearest
    pair = lambda side: F.when(F.col("_p").isNotNull(), F.struct(F.col("_p").alias("a"), F.col(side).alias("b")))
    known = known.withColumn("_l", F.last(pair("_l1"), True).over(back)).withColumn("_r", F.first(pair("_r1"), True).over(on))

    def line(a: Column, b: Column) -> Column:
        return a["y"] + (b["y"] - a["y"]) / (b["x"] - a["x"]) * (F.col(at) - a["x"])

    left, right = F.col("_l"), F.col("_r")
    guess = F.when(left.isNotNull() & right.isNotNull(), line(left["a"], right["a"])).when(left["b"].isNotNull(), line(left["a"], left["b"])).when(right["b"].isNotNull(), line(right["a"], right["b"]))
    return known.select(*keys, at, F.coalesce(F.col(value), guess).alias("filled"))


def resampled(rows: DataFrame, keys: list[str], order: list[str], x: str, y: str, step: float) -> DataFrame:
    """(keys, s, x, y): points on the polyline at every ``step`` of its length, from its beginning."""
    w = W.partitionBy(*keys).orderBy("arc", *order)
    curve = arc_length(rows, keys, order, x, y)
    pieces = curve.select(*keys, "arc", F.col(x).alias("x0"), F.col(y).alias("y0"), *(F.lead(c).over(w).alias(n) for c, n in (("arc", "arc1"), (x, "x1"), (y, "y1"))))
    last = F.ceil(F.col("arc1") / step) - 1  # a piece holds its first point, the next one its last
    inside = pieces.withColumn("k", F.explode(F.when(last >= F.ceil(F.col("arc") / step), F.sequence(F.ceil(F.col("arc") / step), last)).otherwise(F.when(F.col("arc1").isNull() & (F.col("arc") % step == 0), F.array(F.ceil(F.col("arc") / step))))))
    share = F.when(F.col("arc1") > F.col("arc"), (F.col("k") * step - F.col("arc")) / (F.col("arc1") - F.col("arc"))).otherwise(0.0)
    along = lambda a, b: F.col(a) + F.when(F.col(b).isNull(), 0.0).otherwise((F.col(b) - F.col(a)) * share)
    return inside.select(*keys, (F.col("k") * step).alias("s"), along("x0", "x1").alias("x"), along("y0", "y1").alias("y"))


def curvature(rows: DataFrame, keys: list[str], order: list[str], x: str, y: str) -> DataFrame:
    """``radius`` of the circle through each point and its neighbours (1 / curvature); null at the ends and on straight lines."""
    w = W.partitionBy(*keys).orderBy(*order)
    at = lambda c, k: F.lag(c, 1).over(w) if k < 0 else F.lead(c, 1).over(w)
    near = rows.withColumns({"_x0": at(x, -1), "_x1": at(x, 1), "_y0": at(y, -1), "_y1": at(y, 1)})
    length = lambda a, b, c, d: F.sqrt(F.pow(F.col(a) - F.col(c), 2) + F.pow(F.col(b) - F.col(d), 2))
    sides = length("_x0", "_y0", x, y) * length(x, y, "_x1", "_y1") * length("_x0", "_y0", "_x1", "_y1")
    area = F.abs((F.col(x) - F.col("_x0")) * (F.col("_y1") - F.col("_y0")) - (F.col("_x1") - F.col("_x0")) * (F.col(y) - F.col("_y0")))
    return near.withColumn("radius", F.when(area > 0, sides / (2 * area))).drop("_x0", "_x1", "_y0", "_y1")


def without_outliers(rows: DataFrame, keys: list[str], order: list[str], x: str, y: str, factor: float = 4.0, rounds: int = 3, least: int = 5) -> DataFrame:
    """The rows left after at most ``rounds`` removals for each key: each takes the point furthest from its nearest neighbour along
    the order, if that is over ``factor`` times the median step and more than ``least`` points are there.  Of equals the first."""
    columns = rows.columns
    for _ in range(rounds):
        w = W.partitionBy(*keys).orderBy(*order)
        step = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2))
        stepped = rows.withColumn("_s", step).withColumn("_i", F.row_number().over(w))
        alone = stepped.withColumn("_a", F.least("_s", F.lead("_s").over(w)))
        per = alone.groupBy(*keys).agg(F.median("_s").alias("_m"), F.count("*").alias("_n"), F.max(F.struct("_a", -F.col("_i"))).alias("_w"))
        drop = (F.col("_n") > least) & (F.col("_m") > 0) & (F.col("_w._a") > factor * F.col("_m")) & (F.col("_i") == -F.col("_w")["col2"])
        rows = alone.join(per, keys).filter(~F.coalesce(drop, F.lit(False))).select(*columns)
    return rows


def arc_length(rows: DataFrame, keys: list[str], order: list[str], x: str, y: str) -> DataFrame:
    """The running length of the polyline through (x, y)."""
    w = W.partitionBy(*keys).orderBy(*order)
    step = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2))
    return rows.withColumn("_s", F.coalesce(step, F.lit(0.0))).withColumn("arc", F.sum("_s").over(w)).drop("_s")


def smoothed(rows: DataFrame, keys: list[str], order: list[str], value: str, half: int) -> DataFrame:
    """Centred moving average of 2 half + 1 rows, over what there is of them at the ends."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)
    return rows.withColumn("smooth", F.avg(value).over(w))


def isolated(rows: DataFrame, keys: list[str], order: list[str], value: str, factor: float = 4.0) -> DataFrame:
    """Marks rows further from both neighbours than ``factor`` times the median step of their key."""
    w = W.partitionBy(*keys).orderBy(*order)
    steps = rows.withColumn("_p", F.abs(F.col(value) - F.lag(value).over(w))).withColumn("_n", F.abs(F.lead(value).over(w) - F.col(value)))
    median = steps.groupBy(*keys).agg(F.median("_p").alias("_m"))
    return steps.join(median, keys).withColumn("isolated", F.coalesce(F.least("_p", "_n") > factor * F.col("_m"), F.lit(False))).drop("_p", "_n", "_m")


def expand_range(rows: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """A row for each integer of [first, last], whichever way round."""
    return rows.withColumn(name, F.explode(F.sequence(F.least(first, last), F.greatest(first, last))))
