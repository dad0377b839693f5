"""Operator 3, quality rules: compression bands.

Text that zstandard shrinks far more than prose repeats itself; text that it hardly shrinks is noise.  The ratio
(compressed bytes / bytes) of the whole text must lie in the band for its length.  The text is cut into fixed chunks, of which
the last may be shorter; each must lie in the band for the chunk's length, and no more than ``chunk_share`` of them may not.
Every byte of a text is in one chunk.  Short texts and tails carry zstandard's frame as overhead, so their limits differ.

Null and empty texts have no words and fail the base rules.  Repeated rows and null ids are judged each on their own;
an empty table gives an empty result; a text is always judged whole, however long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """(least bytes, lowest ratio, highest ratio) by length, ascending, for whole texts and for chunks of ``chunk`` bytes at most."""

    by_length: tuple[tuple[int, float, float], ...] = ((0, 0.0, 9.0), (100, 0.40, 1.10), (200, 0.34, 0.90), (800, 0.30, 0.80), (3200, 0.25, 0.75), (12800, 0.20, 0.72))
    chunk: int = 2048
    by_chunk: tuple[tuple[int, float, float], ...] = ((0, 0.0, 16.0), (100, 0.30, 1.10), (200, 0.25, 0.95), (800, 0.25, 0.85), (2048, 0.25, 0.80))
    chunk_share: float = 0.25
    level: int = 3


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(words, their code points, symbols, duplicate lines, words in repeated 3-word windows)."""
    raw = text.encode()
    found = raw.split()
    n = len(found)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines, seen, duplicates = raw.split(b"\n"), set(), 0
    if len(lines) > 1:
        for line in lines:
            if line in seen:
                duplicates += 1
            elif line and not line.isspace():
                seen.add(line)
    repeats = 0
    if n > 3:
        first: dict[bytes, int] = {}
        ids = np.fromiter(map(first.setdefault, found, range(n)), np.int64, n)
        _, two = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)
        _, where, count = np.unique(two[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
        if len(count) < n - 2:
            starts = np.flatnonzero(count[where] > 1)
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[starts + k] = True
            repeats = int(covered.sum())
    return n, chars, symbols, duplicates, repeats


def _limits(bands: tuple[tuple[int, float, float], ...], size: int) -> tuple[float, float]:
    return next((low, high) for least, low, high in reversed(bands) if size >= least)


def band_verdict(raw: bytes, bands: Bands, compress) -> tuple[float, int, int, bool]:
    """(whole ratio, chunks, chunks outside their band, inside all bands); an empty text is inside none."""
    if not raw:
        return 0.0, 0, 0, False
    ratio = len(compress(raw)) / len(raw)
    low, high = _limits(bands.by_length, len(raw))
    chunks = outside = 0
    for i in range(0, len(raw), bands.chunk):
        piece = raw[i : i + bands.chunk]
        least, most = _limits(bands.by_chunk, len(piece))
        chunks += 1
        outside += not least <= (ratio if len(piece) == len(raw) else len(compress(piece)) / len(piece)) <= most
    return ratio, chunks, outside, low <= ratio <= high and outside <= bands.chunk_share * chunks


def _judge(text: str, bands: Bands, compress) -> tuple:
    n, chars, symbols, duplicates, repeats = base_counts(text)
    failed = n < 50 or 100 * repeats > 50 * n
    ratio, chunks, outside, good = band_verdict(text.encode(), bands, compress)
    return n, chars, symbols, duplicates, repeats, failed, good and not failed, ratio, chunks, outside


def _compressor(bands: Bands):
    import zstandard

    return zstandard.ZstdCompressor(level=bands.level).compress


_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "zstd_ratio", "n_chunks", "n_chunks_outside")


def quality(docs: DataFrame, bands: Bands = Bands(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts, ratios and verdict of each row."""

    def run(ids: list, rows: list[str]) -> dict:
        compress = _compressor(bands)
        return {"doc_id": ids} | dict(zip(_COLUMNS, zip(*(_judge(t, bands, compress) for t in rows))))

    return common.per_text(common.texts(docs, key, text), run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double, n_chunks long, n_chunks_outside long")


def keep_good(docs: DataFrame, bands: Bands = Bands(), text: str = "text") -> DataFrame:
    """The rows whose text passes, with all their columns."""

    def passes(rows: list) -> list[bool]:
        compress = _compressor(bands)
        return [bool(_judge(t or "", bands, compress)[6]) for t in rows]

    return docs.filter(common.text_udf(passes, "boolean")(F.col(text).cast("string")))
