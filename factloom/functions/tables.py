"""Table functions: rows from a text, for lateral joins."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_NUMBER, _LETTER, _END = re.compile(r"([0-9])\.([0-9])"), re.compile(r"(?<![^\W])([A-Za-z])\.(?=[A-Za-z]\.|\s*[0-9])"), re.compile(r"([.;:])[ \t\n\v\f\r]+")


class SentenceRows:
    """(place, sentence): the sentences of a text, numbered from 1, split as ``text.sentences`` splits them; none of a null."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        if text is None:
            return
        guarded = _NUMBER.sub("\\1\u0001\\2", text)
        guarded = _LETTER.sub("\\1\u0001", guarded)
        place = 0
        for part in _END.sub("\\1\u0002", guarded).split("\u0002"):
            sentence = part.replace("\u0001", ".").strip(" ")
            if sentence:
                place += 1
                yield place, sentence


class RangeRows:
    """(first, last): the ranges of positions that a text states ("17 to 27")."""

    _RANGE = re.compile(r"\b([1-4][1-8])\s*(?:to|-|–|—|until|through)\s*([1-4][1-8])\b")

    def eval(self, text: str) -> Iterator[tuple[int, int]]:
        for m in self._RANGE.finditer(_NUMBER.sub("\\1\\2", text or "")):
            yield int(m[1]), int(m[2])


class LastRows:
    """(key, last, n) of a partition of (key, value) rows: one row when its last row has been seen; ``PARTITION BY`` deals the input."""

    def __init__(self) -> None:
        self.key, self.last, self.n = None, None, 0

    def eval(self, row) -> None:
        self.key, self.last, self.n = row["key"], row["value"], self.n + 1

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            yield self.key, self.last, self.n


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL: sentence_rows, range_rows, last_rows."""
    spark.udtf.register("sentence_rows", udtf(SentenceRows, returnType="place int, sentence string"))
    spark.udtf.register("range_rows", udtf(RangeRows, returnType="first int, last int"))
    spark.udtf.register("last_rows", udtf(LastRows, returnType="key long, last double, n int"))
