"""Points in intervals and overlapping intervals: pairs by equality joins on aligned blocks, counts and sums by running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import settled

_BITS = 10  # places of a level under one of the next

def aligned_blocks(low: Column, high: Column) -> Column:
    """The closed interval of integers as the fewest blocks [block * 2^level, (block + 1) * 2^level): array<struct<level, block>>.

    There are two of a level at most, so O(log length) in all; none if ``high`` is below ``low`` or either is null.
    """
    whole = "struct<lo:bigint,hi:bigint,out:array<struct<level:int,block:bigint>>>"
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(high - low + 2, F.lit(2)))).cast("int"))

    def narrower(s: Column, level: Column) -> Column:
        odd_low, odd_high = s["lo"] % 2 != 0, s["hi"] % 2 != 0
        none = F.array().cast("array<struct<level:int,block:bigint>>")
        block = lambda at: F.array(F.struct(level.cast("int").alias("level"), at.alias("block")))
        taken = F.concat(s["out"], F.when(odd_low, block(s["lo"])).otherwise(none), F.when(odd_high, block(s["hi"] - 1)).otherwise(none))
        half = lambda at: F.shiftright(at, 1)
        inner = F.struct(half(s["lo"] + odd_low.cast("long")).alias("lo"), half(s["hi"] - odd_high.cast("long")).alias("hi"), taken.alias("out"))
        return F.when(s["lo"] < s["hi"], inner).otherwise(s)

    start = F.struct(low.cast("long").alias("lo"), (high.cast("long") + 1).alias("hi"), F.array().alias("out")).cast(whole)
    return F.aggregate(levels, start, narrower, lambda s: s["out"])


def range_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, keys: list[str] | None = None) -> DataFrame:
    """Every point with every interval [low, high] that holds it, whatever their lengths; ``keys`` are equal on both sides.

    An interval is cut into aligned blocks and a point names its block at each level that intervals use, so the join is on
    equality: no nested loop, no row for each integer.  A point is in one block of an interval at most: nothing comes twice.
    Columns must have different names but for ``keys``.  Nulls hold nothing.
    """
    keys = keys or []
    cut = intervals.withColumn("_b", F.explode(aligned_blocks(F.col(low), F.col(high)))).select("*", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")).drop("_b")
    used = sorted(r[0] for r in cut.select("_level").distinct().collect())  # 64 at most
    if not used:
        used = [0]
    named = points.withColumn("_level", F.explode(F.array(*map(F.lit, used)))).withColumn("_block", F.expr(f"shiftright(CAST(`{at}` AS BIGINT), _level)"))
    # blocks are many more than the rows they are cut from, by which Spark would judge whether to broadcast them
    return named.join(cut.hint("merge"), [*keys, "_level", "_block"]).drop("_level", "_block")


def overlaps(left: DataFrame, right: DataFrame, of_left: tuple[str, str], of_right: tuple[str, str], keys: list[str] | None = None) -> DataFrame:
    """Every pair of intervals that share an integer: one begins inside the other."""
    begun = range_join(left, right, of_left[0], *of_right, keys)
    other = range_join(right, left, of_right[0], *of_left, keys).filter(F.col(of_right[0]) > F.col(of_left[0]))
    return begun.unionByName(other.select(*begun.columns))


def running(rows: DataFrame, points: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """(keys, _t, sums): at every place ``_t`` of rows or points the sums of the rows at it and before it.

    Places are summed up by groups of 1,024 neighbours, these again, until one is left; back down each level adds what lies before it
    in its group.  No window holds more than 1,024 rows, however the places are spread.
    """
    kinds = dict(rows.dtypes)
    every = rows.select(*keys, "_t", *sums).unionByName(points.select(*keys, "_t", *(F.lit(0).cast(kinds[s]).alias(s) for s in sums)))
    own = settled(every.dropna(subset=[*keys, "_t"]).groupBy(*keys, "_t").agg(*(F.sum(s).alias(s) for s in sums)))
    low, high = own.agg(F.min("_t"), F.max("_t")).first()
    if low is None:
        return own
    levels = [own.withColumn("_n", F.col("_t") - low)]
    while (high - low) >> (_BITS * len(levels)):
        levels.append(levels[-1].groupBy(*keys, F.shiftright("_n", _BITS).alias("_n")).agg(*(F.sum(s).alias(s) for s in sums)))
    before = None
    for depth, level in reversed(list(enumerate(levels))):
        up = level.withColumn("_p", F.shiftright("_n", _BITS))
        w = W.partitionBy(*keys, "_p").orderBy("_n").rowsBetween(W.unboundedPreceding, -1 if depth else 0)
        up = up.withColumns({s: F.coalesce(F.sum(s).over(w), F.lit(0)) for s in sums})
        if before is not None:
            up = up.join(before.select(*keys, F.col("_n").alias("_p"), *(F.col(s).alias(f"_b_{s}") for s in sums)), [*keys, "_p"])
            up = up.withColumns({s: F.col(s) + F.col(f"_b_{s}") for s in sums})
        before = up
    return before.select(*keys, "_t", *sums)


def held(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, sums: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """``points`` with sums (of whole or decimal numbers) over the intervals that hold them: what has begun less what has ended.

    No pair is formed, so the work grows with points and intervals and not with how many intervals are open at a time.
    """
    keys = keys or []
    own = intervals.select(*keys, F.col(low).cast("long").alias("_lo"), F.col(high).cast("long").alias("_hi"), *(c.alias(n) for n, c in sums.items())).filter("_lo <= _hi")
    begun = own.select(*keys, F.col("_lo").alias("_t"), *sums)
    ended = own.select(*keys, (F.col("_hi") + 1).alias("_t"), *((-F.col(n)).cast(dict(own.dtypes)[n]).alias(n) for n in sums))
    given = points.withColumn("_t", F.col(at).cast("long"))
    found = running(begun.unionByName(ended), given.select(*keys, "_t").distinct(), keys, list(sums))
    return given.join(found.hint("merge"), [*keys, "_t"], "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in sums}).drop("_t")


def overlap_summary(left: DataFrame, right: DataFrame, of_left: tuple[str, str], of_right: tuple[str, str], key: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """(key, n, least): of each left interval that shares an integer with right ones how many these are, and their least ``value``.

    No pair is formed.  n is what has begun by an interval's end less what has ended before its begin.  The least value is that of
    intervals that begin inside it, by its own blocks, or hold its begin, by theirs; both sides meet on the least value of a block.
    ``key`` is one row's; empty intervals and nulls share nothing.
    """
    keys = keys or []
    bounds = lambda df, of, *more: df.select(*keys, *more, F.col(of[0]).cast("long").alias("_lo"), F.col(of[1]).cast("long").alias("_hi")).dropna(subset=[*keys, "_lo", "_hi"]).filter("_lo <= _hi")
    a, b = bounds(left, of_left, F.col(key).alias("_id")), bounds(right, of_right, F.col(value).alias("_v"))
    count = lambda t, begun: b.select(*keys, t.alias("_t"), F.lit(begun).cast("long").alias("begun"), F.lit(1 - begun).cast("long").alias("ended"))
    places = a.select(*keys, F.explode(F.array("_lo", "_hi")).alias("_t")).distinct()
    sums = settled(running(count(F.col("_lo"), 1).unionByName(count(F.col("_hi") + 1, 0)), places, keys, ["begun", "ended"]))
    at = lambda t, n: sums.select(*keys, F.col("_t").alias(t), n).hint("merge")
    counted = a.join(at("_hi", "begun"), [*keys, "_hi"]).join(at("_lo", "ended"), [*keys, "_lo"]).select("_id", (F.col("begun") - F.col("ended")).alias("n")).filter("n > 0")
    longest = lambda df: (df.agg(F.max(F.col("_hi") - F.col("_lo") + 1)).first()[0] or 1).bit_length()
    own, theirs = (F.sequence(F.lit(0), F.lit(longest(df) - 1)) for df in (a, b))  # a block is no longer than what is cut
    cut, begin = F.inline(aligned_blocks(F.col("_lo"), F.col("_hi"))), lambda levels: F.explode(levels).alias("level")
    point = F.expr("shiftright(_lo, level)").alias("block")
    least = lambda df, held: df.groupBy(*keys, "level", "block").agg(F.min("_v").alias("_v")).withColumn("held", F.lit(held))
    lowest = least(b.select(*keys, "_v", "_lo", begin(own)).select(*keys, "_v", "level", point), False).unionByName(least(b.select(*keys, "_v", cut), True))
    asked = a.select(*keys, "_id", cut).withColumn("held", F.lit(False)).unionByName(a.select(*keys, "_id", "_lo", begin(theirs)).select(*keys, "_id", "level", point).withColumn("held", F.lit(True)))
    first = asked.join(lowest.hint("merge"), [*keys, "held", "level", "block"]).groupBy("_id").agg(F.min("_v").alias("least"))
    return counted.join(first.hint("merge"), "_id").select(F.col("_id").alias(key), "n", "least")
