"""Operator 11, filter interaction audit: lattice-edge aggregation.

A filter's effect depends only on the set of filters applied before it, not on their order.  So a document contributes to the 80
edges (set already applied, next filter) of the lattice of five filters, and the 600 steps of all 120 orders are paths over the
aggregated edges.  Documents are counted by failed set first, so what is spread over the edges is at most 32 sets for each part and
kind of label, whatever the input's size.

The duplicate filter E compares digests of the whole texts (SHA-256).  Counts by (text, part, label) are gathered before the least
doc_id of a text is taken, so a text that holds a third of all rows is a few rows when its group meets.

Null texts are empty texts, null parts the empty string; an empty table gives no rows.  Repeated rows are counted each: rows of the
same doc_id do not fail E against each other, and a row without doc_id neither fails E nor makes others fail.  Several labels of one
doc_id count as 1 if any is 1.  Other columns are not read; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DUPLICATE = "E"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


#: Failure conditions of single texts; ``words`` is the array of a text's words.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 50,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
    "C": lambda text, words: 100 * (F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))) > 5 * F.char_length(text),
    "D": lambda text, words: text.rlike(r"[#$%&*|]"),
}


def edges(letters: str) -> list[tuple[int, int]]:
    """(bits of the set already applied, place of the next filter) of every edge of the lattice."""
    places = range(len(letters))
    return [(sum(1 << i for i in held), k) for k in places for size in places for held in combinations([i for i in places if i != k], size)]


def steps(letters: str) -> list[tuple[str, int, int, int]]:
    """(order, step, bits of the set applied before it, place of its filter) of every step of every order."""
    out = []
    for order in permutations(range(len(letters))):
        before = 0
        for step, k in enumerate(order, 1):
            out.append(("".join(letters[i] for i in order), step, before, k))
            before |= 1 << k
    return out


def failed_sets(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] = FILTERS, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part and label fail just the filters whose bits are set; the highest
    bit is the duplicate filter's."""
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("words", _words(F.col("text")))
    bits = [F.when(fails(F.col("text"), F.col("words")), F.lit(1 << i)).otherwise(0) for i, fails in enumerate(filters.values())]
    marked = own.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).cast("int").alias("mask"))
    rows = marked.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    marks = labels.select(F.col(key).cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    rows = rows.join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    kinds = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_nameless"))
    least = F.min("first").over(W.partitionBy("digest"))
    kept = F.col("n_nameless") + F.when(F.col("first") == least, F.col("n_first")).otherwise(0)
    both = kinds.withColumn("kept", kept).select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("kept").alias("n")), F.struct(F.col("mask").bitwiseOR(1 << len(filters)).alias("mask"), (F.col("n") - F.col("kept")).alias("n")))).alias("s"))
    return both.select("part", "good", "toxic", "s.*").filter("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def lattice_edges(sets: DataFrame, letters: str) -> DataFrame:
    """(part, before, place, kept, removed, redundant, unique_fails, good_lost, toxic_lost) of every edge, from ``failed_sets``."""
    each = sets.withColumn("e", F.explode(F.array(*(F.struct(F.lit(b).alias("before"), F.lit(k).alias("place")) for b, k in edges(letters))))).select("part", "mask", "good", "toxic", "n", "e.*")
    own = F.expr("shiftleft(1, place)")
    fails, gone = F.col("mask").bitwiseAND(own) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    counted = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": F.col("mask") == own, "good_lost": fails & ~gone & F.col("good"), "toxic_lost": fails & ~gone & F.col("toxic")}
    return each.groupBy("part", "before", "place").agg(*(F.sum(F.when(what, F.col("n")).otherwise(0)).alias(name) for name, what in counted.items()))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] = FILTERS, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): every step of every order
    of ``filters`` and the duplicate filter, which is the last letter."""
    letters = "".join(filters) + DUPLICATE
    found = lattice_edges(failed_sets(docs, labels, filters, key, text, part), letters)
    # an edge lies on |before|! (rest)! orders
    ways = [factorial(b.bit_count()) * factorial(max(0, len(letters) - 1 - b.bit_count())) for b in range(1 << len(letters))]
    weight = F.element_at(F.array(*map(F.lit, ways)), F.col("before") + 1)
    found = found.withColumn("shapley", F.sum(F.col("removed") * weight).over(W.partitionBy("part", "place")))
    paths = docs.sparkSession.createDataFrame(steps(letters), "filter_order string, step int, before int, place int")  # fixed by the number of filters
    return found.join(F.broadcast(paths), ["before", "place"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
