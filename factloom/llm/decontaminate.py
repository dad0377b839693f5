"""Operator 10, benchmark decontamination: q-gram lemma filtering.

Texts are folded first: single-code-point lower case, white space runs to one blank.  An item of m characters may be met
with up to e = ``rate`` * m edits; then at least m - q + 1 - q * e of its q-grams recur in the document on diagonals
(document place minus item place) that spread over e at most.  Hits are counted in diagonal bands of width 2(e + 1), each
overlapping the next by half, so that every match lies whole in one band; bands with enough hits are verified by
alignment inside the band.  Items too short for the bound take fewer edits, down to none; items shorter than q are
searched for as they are.

Items are taken to the executors in blocks of ``block_chars`` characters, one pass over the documents for each block.
Null and empty texts and items match nothing; null ids are carried through; repeated rows and items each give matches; of
overlapping matches of an item the one with fewest edits counts, of those the first; columns besides ids and texts are not
read by ``matches`` and kept by ``keep_clean``; empty tables give none.  Texts are read whole, some 60 bytes of memory for
each character of a long one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import _powers, ragged

_COST = np.int64(1) << 32
_BITS = 22
MATCH = "doc_id long, item_id long, begin long, end long, edits long, n_hits long"


@cache
def _fold_table() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            ch = chr(c)
            low = ch.lower()
            if len(low) == 1:
                table[c] = ord(low)
            if ch.isspace():
                table[c] = 32
    return table


def fold(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points, and the place of each in the text."""
    code = _fold_table()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    blank = code == 32
    keep = np.ones(len(code), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return code[keep], np.flatnonzero(keep)


def _grams(code: np.ndarray, q: int) -> np.ndarray:
    n = len(code)
    if n < q:
        return np.zeros(0, np.uint64)
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((code.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * up[:n], out=total[1:])
        h = (total[q:] - total[:-q]) * down[: n - q + 1]
        return (h ^ h >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], q: int, rate: float):
        self.q = q
        self.ids = [i for i, _ in items]
        self.codes = [fold(t)[0] for _, t in items]
        self.size = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.maximum(0, np.minimum((rate * self.size).astype(np.int64), (self.size - q) // q))
        self.least = np.maximum(1, self.size - q + 1 - q * self.edits)
        grams = [_grams(c, q) for c in self.codes]
        counts = [len(g) for g in grams]
        every = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item, place = np.repeat(np.arange(len(items)), counts), np.concatenate([*(np.arange(c) for c in counts), np.zeros(0, np.int64)])
        order = np.argsort(every, kind="stable")
        self.keys, first = np.unique(every[order], return_index=True)
        self.item, self.place = item[order], place[order].astype(np.int64)
        self.first, self.count = first, np.diff(np.append(first, len(every)))
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.short = [k for k, c in enumerate(self.codes) if 0 < len(c) < q]

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item, begin, end, edits, hits) of all matches; begin and end are code points of the text."""
        joined = "\0".join(texts)
        code, origin = fold(joined)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        raw_start = np.cumsum(np.append(0, lengths[:-1] + 1))
        start = np.searchsorted(origin, raw_start)
        stop = np.searchsorted(origin, raw_start + lengths)
        for k in self.short:
            yield from self._plain(k, code, origin, raw_start, start, stop)
        grams = _grams(code, self.q)
        if not len(grams) or not len(self.keys):
            return
        at = np.flatnonzero(self.seen[(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
        found = np.searchsorted(self.keys, grams[at])
        found[found == len(self.keys)] = 0
        real = self.keys[found] == grams[at]
        at, found = at[real], found[real]
        if not len(at):
            return
        counts = self.count[found]
        item = ragged(self.item, self.first[found], counts)
        place = ragged(self.place, self.first[found], counts)
        at = np.repeat(at, counts)
        text = np.searchsorted(start, at, side="right") - 1
        diagonal = at - start[text] - place
        band = diagonal // (self.edits[item] + 1)
        pair = text * len(self.ids) + item
        key = np.concatenate([pair << 31 | (band + (1 << 24)), pair << 31 | (band - 1 + (1 << 24))])
        uniq, hits = np.unique(key, return_counts=True)
        pair, band = uniq >> 31, (uniq & ((1 << 31) - 1)) - (1 << 24)
        enough = hits >= self.least[pair % len(self.ids)]
        pair, band, hits = pair[enough], band[enough], hits[enough]
        text, item = pair // len(self.ids), pair % len(self.ids)
        best: dict[tuple[int, int], list] = {}
        for k in np.unique(item).tolist():
            own = np.flatnonzero(item == k)
            for lot in np.array_split(own, -(-len(own) // 256)):
                cost, begin, end = self._align(k, code, start[text[lot]], stop[text[lot]], band[lot])
                for i in np.flatnonzero(cost <= self.edits[k]).tolist():
                    t = int(text[lot[i]])
                    a, b = origin[begin[i]] - raw_start[t], origin[end[i] - 1] + 1 - raw_start[t]
                    best.setdefault((t, k), []).append((int(cost[i]), int(a), int(b), int(hits[lot[i]])))
        for (t, k), rows in best.items():
            taken: list[tuple[int, int]] = []
            for cost, a, b, n in sorted(rows):
                if all(b <= x or y <= a for x, y in taken):  # of overlapping matches the one with fewest edits
                    taken.append((a, b))
                    yield t, k, a, b, cost, n

    def _plain(self, k, code, origin, raw_start, start, stop) -> Iterator[tuple[int, int, int, int, int, int]]:
        item = self.codes[k]
        m = len(item)
        hit = np.ones(max(0, len(code) - m + 1), bool)
        for j in range(m):
            hit &= code[j : len(code) - m + 1 + j] == item[j]
        for p in np.flatnonzero(hit).tolist():
            t = int(np.searchsorted(start, p, side="right")) - 1
            if p + m <= stop[t]:
                yield t, k, int(origin[p] - raw_start[t]), int(origin[p + m - 1] + 1 - raw_start[t]), 0, 1

    def _align(self, k: int, code: np.ndarray, start: np.ndarray, stop: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edits, begin, end) of the item's best alignment in each band: costs and start places move together row by row."""
        item, e = self.codes[k].astype(np.int64), int(self.edits[k])
        m, width = len(item), 4 * e + 3  # the band's diagonals, and e to either side
        low = start + band * (e + 1) - e
        at = low[:, None] + np.arange(m + width)
        inside = (at >= start[:, None]) & (at < stop[:, None])
        window = np.where(inside, code[np.clip(at, 0, len(code) - 1)].astype(np.int64), -1)
        step = np.arange(width) * _COST
        far = _COST * (m + width + 1)
        row = np.broadcast_to(np.arange(width), (len(band), width)).astype(np.int64)  # free start: cost 0, begin = column
        for i in range(m):
            new = row + (window[:, i : i + width] != item[i]) * _COST
            skipped = np.concatenate([row[:, 1:] + _COST, np.full((len(band), 1), far)], axis=1)
            new = np.minimum(new, skipped)
            row = np.minimum.accumulate(new - step, axis=1) + step
        final = np.where((at[:, m - 1 : m - 1 + width] < stop[:, None]), row, far)
        column = final.argmin(axis=1)
        value = final[np.arange(len(band)), column]
        begin = np.maximum(low + (value & (_COST - 1)), start)
        end = np.maximum(np.minimum(low + m + column, stop), begin + 1)
        return value >> 32, begin, end


def item_blocks(items: DataFrame, block_chars: int, key: str = "item_id", text: str = "text") -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks; the driver holds one block at a time."""
    block: list[tuple[int | None, str]] = []
    size = 0
    for row in items.select(F.col(key).cast("long"), F.col(text).cast("string")).toLocalIterator():
        if row[1]:
            block.append((row[0], row[1]))
            size += len(row[1])
            if size >= block_chars:
                yield block
                block, size = [], 0
    if block:
        yield block


def _matching(held, q: int, rate: float):
    def run(ids: list, rows: list[str]) -> dict:
        index = _index(held, q, rate)
        got = list(index.search(rows))
        return {"doc_id": [ids[g[0]] for g in got], "item_id": [index.ids[g[1]] for g in got], "begin": [g[2] for g in got], "end": [g[3] for g in got], "edits": [g[4] for g in got], "n_hits": [g[5] for g in got]}

    return run


def matches(docs: DataFrame, items: DataFrame, rate: float = 0.08, q: int = 9, block_chars: int = 4_000_000, key: str = "doc_id", text: str = "text", item_key: str = "item_id") -> DataFrame:
    """(doc_id, item_id, begin, end, edits, n_hits): each place where a document holds an item within its edit budget."""
    spark = docs.sparkSession
    found = None
    for block in item_blocks(items, block_chars, item_key):
        part = common.per_text(common.texts(docs, key, text), _matching(spark.sparkContext.broadcast((uuid.uuid4().hex, block)), q, rate), MATCH)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], MATCH)


def _index(held, q: int, rate: float) -> Index:
    name, block = held.value
    return common.kept("q-grams", (name, q, rate), lambda: Index(block, q, rate))


def _clean(held, q: int, rate: float):
    def run(rows: list) -> list[bool]:
        index, out, i = _index(held, q, rate), [True] * len(rows), 0
        while i < len(rows):
            j, size = i, 0
            while j < len(rows) and (size < 1_000_000 or j == i):
                size += len(rows[j] or "")
                j += 1
            for g in index.search([t or "" for t in rows[i:j]]):
                out[i + g[0]] = False
            i = j
        return out

    return common.text_udf(run, "boolean")


def keep_clean(docs: DataFrame, items: DataFrame, rate: float = 0.08, q: int = 9, block_chars: int = 4_000_000, text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The rows that hold no item, with all their columns."""
    spark = docs.sparkSession
    for block in item_blocks(items, block_chars, item_key):
        docs = docs.filter(_clean(spark.sparkContext.broadcast((uuid.uuid4().hex, block)), q, rate)(F.col(text).cast("string")))
    return docs
