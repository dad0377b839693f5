"""Scalar functions on texts, enums and lists, as columns."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.dims import SWEEP

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def tokens(text: Column) -> Column:
    """Words (letters, numbers, underscores of any script) and single marks, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences end at . ; : before white space; points in numbers (4.8) end none, nor those after a single letter that another
    such letter or a number follows (e.d. 34)."""
    t = F.regexp_replace(text, r"([0-9])\.([0-9])", "$1\u0001$2")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}_])([A-Za-z])\.(?=[A-Za-z]\.|\s*[0-9])", "$1\u0001")
    t = F.regexp_replace(t, r"([.;:])\s+", "$1\u0002")
    parts = F.transform(F.split(t, "\u0002"), lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit("."))))
    return F.filter(parts, lambda s: s != "")


def matching(parts: Column, keyword: str, noise: str, strong: str) -> Column:
    """The sentences with the keyword, without those that are noise, unless they are strong."""
    return F.filter(parts, lambda s: s.rlike(keyword) & ~(s.rlike(noise) & ~s.rlike(strong)))


def case_of(name: Column) -> Column:
    """The case id at the start of a file name, else the whole stem."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    found = F.regexp_extract(stem, r"^([A-Z]+[0-9]+)(?:_.+)?$", 1)
    return F.when(found != "", found).otherwise(stem)


def reader_of(name: Column) -> Column:
    found = F.regexp_extract(F.regexp_replace(name, r"\.[^.]*$", ""), r"^[A-Z]+[0-9]+_(.+)$", 1)
    return F.when(found != "", found)


def positions_in(text: Column) -> Column:
    """Two-digit positions 11..48 of a text, written 48 or 4.8, in order of appearance, each once."""
    found = F.regexp_extract_all(text, F.lit(r"\b([1-4]\.?[1-8])\b"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda s: F.replace(s, F.lit("."), F.lit("")).cast("int")))


def enum_separators(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(value)), r"[\s\-]+", "_")


def enum_by_prefix(value: Column, allowed: list[str]) -> Column:
    """The allowed value itself, else the only one that begins with the value or begins it, else null."""
    options = F.array(*(F.lit(a) for a in allowed))
    fits = F.filter(options, lambda a: F.startswith(a, value) | F.startswith(value, a))
    return F.when(F.array_contains(options, value), value).when((value != "") & (F.size(fits) == 1), F.get(fits, F.lit(0)))


def as_list(value: Column) -> Column:
    """A scalar as a list of one, null as the empty list."""
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value.cast("string")))


def join_list(items: Column) -> Column:
    """a / a and b / a, b, and c."""
    texts = F.transform(items, lambda x: x.cast("string"))
    n = F.size(texts)
    return (
        F.when(n == 0, "").when(n == 1, F.get(texts, F.lit(0)))
        .when(n == 2, F.concat(F.get(texts, F.lit(0)), F.lit(" and "), F.get(texts, F.lit(1))))
        .otherwise(F.concat(F.array_join(F.slice(texts, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(texts, -1)))
    )


def plural(word: str, items: Column) -> Column:
    return F.when(F.size(items) == 1, word).otherwise(word + "s")


def is_meaningful(value: Column, dull: tuple[str, ...] = ("normal", "none", "regular", "not_applicable", "fully_erupted", "complete", "well")) -> Column:
    """Whether an answer says more than that all is well; case and blanks at its ends do not matter."""
    said = F.lower(F.trim(value))
    return F.coalesce((said != "") & ~said.isin(*dull), F.lit(False))


# fixed values: what joins the ends of a range; a bare hyphen joins the items of a list as well
JOINS = "to|-|–|—|until|through"
RANGE_JOINS = "(?i:to|until|through)|–|—"


def _flat(text: Column) -> Column:
    """A text with its positions written 48, not 4.8."""
    return F.regexp_replace(text, r"([0-9])\.([0-9])", "$1$2")


def _ranges(flat: Column, joins: str) -> Column:
    found = F.regexp_extract_all(flat, F.lit(rf"\b[1-4][1-8]\s*(?:{joins})\s*[1-4][1-8]\b"), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.substring(m, 1, 2).cast("int").alias("first"), F.substring(m, -2, 2).cast("int").alias("last")))


def _swept(flat: Column, joins: str) -> Column:
    """The positions inside the ranges of a flat text, range by range; a position's place is looked up, not searched for."""
    order = [p for arch in SWEEP.values() for p in arch]
    places = F.array(*(F.lit(order.index(p) if p in order else None).cast("int") for p in range(max(order) + 1)))
    every, half, none = F.array(*map(F.lit, order)), len(order) // 2, F.array().cast("array<int>")
    placed = F.transform(_ranges(flat, joins), lambda r: F.struct(F.get(places, r["first"]).alias("a"), F.get(places, r["last"]).alias("b")))
    cut = lambda r: F.slice(every, F.least(r["a"], r["b"]) + 1, F.abs(r["a"] - r["b"]) + 1)
    return F.flatten(F.transform(placed, lambda r: F.when((r["a"] < half) == (r["b"] < half), cut(r)).otherwise(none)))


def ranges_in(text: Column, joins: str = JOINS) -> Column:
    """The ranges of positions in a text ("17 to 27", "34-37") as an array of structs (first, last)."""
    return _ranges(_flat(text), joins)


def range_positions(text: Column, joins: str = JOINS) -> Column:
    """The positions inside a text's ranges, ends included, along the arch; a range over two arches has none."""
    return F.array_sort(F.array_distinct(_swept(_flat(text), joins)))


def swept_by(text: Column, clauses: list[str], unless: str) -> Column:
    """An array: for each of ``clauses`` the positions inside the ranges of a text's sentences that match it, without the clauses (between
    commas) that match ``unless``; in ascending order.  Lists joined by hyphens are no ranges.  A null text sweeps nothing.

    Sentences are split and their ranges read once, whatever the number of clauses.
    """
    says = lambda s: [s.rlike(c) for c in clauses]
    about = F.filter(F.split(_flat(F.coalesce(text, F.lit(""))), r"(?<=[.;:])\s+"), lambda s: reduce(or_, says(s)))
    parts = lambda s: F.filter(F.split(s, "[,;]"), lambda p: ~p.rlike(unless))
    kinds = lambda s: F.array(*(says(s) if len(clauses) > 1 else [F.lit(True)]))
    read = F.transform(about, lambda s: F.struct(kinds(s).alias("says"), F.flatten(F.transform(parts(s), lambda p: _swept(p, RANGE_JOINS))).alias("fdis")))
    chosen = lambda r, k: F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(r, lambda x: x["says"][k]), lambda x: x["fdis"]))))
    return F.transform(F.array(read), lambda r: F.array(*(chosen(r, k) for k in range(len(clauses)))))[0]


def swept_positions(text: Column, clause: str, unless: str) -> Column:
    """``swept_by`` one clause."""
    return swept_by(text, [clause], unless)[0]


def numbers_named(text: Column) -> Column:
    """The two-digit positions a text writes, deciduous ones too, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_flat(text), F.lit(r"\b([1-8][1-8])\b"), F.lit(1)), lambda x: x.cast("int")))


def named_positions(text: Column) -> Column:
    """All positions a text names, and those inside its ranges, in ascending order."""
    return F.array_sort(F.array_union(numbers_named(text), range_positions(text)))


def position_list(values: Column, arch: str, ascending: bool = False) -> Column:
    """Texts as positions of an arch: digits only, each once, along the arch or in ascending order."""
    digits = F.filter(F.transform(values, lambda v: F.when(F.trim(v).rlike(r"^[0-9]{2}$"), F.trim(v).cast("int"))), lambda x: x.isNotNull())
    kept = F.array_intersect(F.array(*map(F.lit, SWEEP[arch])), digits)
    return F.array_sort(kept) if ascending else kept


def without_label(text: Column, label: str) -> Column:
    """A text without its leading label ("Mandible: ..."), unless nothing else would be left."""
    body = F.trim(F.regexp_replace(text, rf"(?i)^\s*{re.escape(label)}\s*:\s*", ""))
    return F.when(body == "", F.trim(text)).otherwise(body)


def short_fact(name: Column) -> Column:
    """``tooth_36_eruption`` -> ``eruption``: a position's fact without its position."""
    return F.regexp_replace(name, r"^tooth_(?:[0-9]{2}|NN)_", "")


def mention_rate(text: Column, pattern: str) -> Column:
    """An aggregate: the share of texts that match."""
    return F.avg(F.coalesce(text.rlike(pattern), F.lit(False)).cast("int"))


def as_bool(value: Column) -> Column:
    """Text answers: yes/true/1 and no/false/0; anything else is no answer."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("true", "yes", "1"), F.lit(True)).when(v.isin("false", "no", "0"), F.lit(False))


def version_key(name: Column) -> Column:
    """Numbers of a versioned name as an array that sorts by value: v6.10 after v6.9."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"([0-9]+)"), F.lit(1)), lambda x: x.cast("int"))
