"""Containment of passages in texts: one pass of an automaton over each text finds any of a lot of passages."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_built: dict[str, object] = {}


def _automaton(held):
    """The worker's automaton of the lot; one lot is kept."""
    import ahocorasick

    name, passages = held.value
    if name not in _built:
        _built.clear()
        found = ahocorasick.Automaton()
        for p in passages:
            found.add_word(p, True)
        found.make_automaton()
        _built[name] = found
    return _built[name]


def _lots(items: DataFrame, text: str, bound: int) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for row in items.filter(F.length(text) > 0).select(text).toLocalIterator():
        held.append(row[0])
        size += len(row[0])
        if size >= bound:
            yield held
            held, size = [], 0
    if held:
        yield held


def _holds(held):
    @F.pandas_udf("boolean")
    def run(rows: pd.Series) -> pd.Series:
        search = _automaton(held)
        return pd.Series([t is not None and next(search.iter(t), None) is not None for t in rows], index=rows.index, dtype="bool")

    return run


def containing(docs: DataFrame, items: DataFrame, key: str, text: str, item_text: str, bound: int = 4_000_000) -> DataFrame:
    """The keys of the texts that contain a passage.

    The passages are a query set.  Lots of at most about ``bound`` characters go to every task, one pass over the texts for
    each lot; the driver holds one lot at a time.  A text's work does not grow with the number of passages.
    """
    spark = docs.sparkSession
    found = None
    for lot in _lots(items, item_text, bound):
        held = spark.sparkContext.broadcast((uuid.uuid4().hex, lot))
        part = docs.filter(_holds(held)(F.col(text))).select(key)
        found = part if found is None else found.unionByName(part).distinct()
    return docs.filter(F.lit(False)).select(key) if found is None else found
