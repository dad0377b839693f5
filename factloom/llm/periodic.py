"""Operator 13, periodic run detection: bit-parallel lags.

The ids of a text's words are laid out as bit planes, big integers with one bit for each word.  XOR of a plane with itself shifted
by p marks the places whose words differ p on; OR over the planes gives all mismatches of lag p.  ANDs of shifted copies, doubling
the shift, leave what begins a stretch of matches long enough for a run.  A lag is given up at the first plane that leaves no such
stretch, which for most lags is the first.

A run is a stretch of consecutive words with smallest period q and length >= max(``least``, ``repeats`` * q) that no neighbouring
word extends.  With four repeats a multiple of q gives the same stretch, so a stretch already found has a smaller period.  Work for
one text grows with the square of its words over 64, memory with its words.

Null and empty texts have no words and no runs.  Repeated rows are judged each on their own, rows without doc_id as if its digits
were none; runs of equal length give the smallest start, then period.  An empty table gives an empty result; other columns are not
read; texts are read whole.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame

from . import common


def planes(ids: np.ndarray) -> list[int]:
    """Bit b of the id of word i is bit i of plane b."""
    top = int(ids.max()) if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> b) & 1, bitorder="little").tobytes(), "little") for b in range(top.bit_length())]


def _long_stretches(match: int, length: int) -> int:
    """The places from which ``length`` bits of ``match`` are set."""
    have = 1
    while match and have < length:
        step = min(have, length - have)
        match &= match >> step
        have += step
    return match


def _stretches(starts: int, length: int) -> list[tuple[int, int]]:
    """(first place, number of set bits) of the stretches that ``_long_stretches`` has found."""
    first, last = starts & ~(starts << 1), starts & ~(starts >> 1)
    if first.bit_count() > 8:
        n = (starts.bit_length() + 7) // 8
        at, to = (np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes(n, "little"), np.uint8), bitorder="little")) for x in (first, last))
        return [(a, b - a + length) for a, b in zip(at.tolist(), to.tolist())]
    out = []
    while first:
        a, b = first & -first, last & -last
        out.append((a.bit_length() - 1, b.bit_length() - a.bit_length() + length))
        first ^= a
        last ^= b
    return out


def runs(words: list, least: int = 6, repeats: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period.  ``repeats`` is 2 at least."""
    if repeats < 2:
        raise ValueError("a run repeats its period twice at least")
    n = len(words)
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen) + 1) for w in words), np.int64, n)  # from 1, so that there is a plane
    bits, found = planes(ids), {}
    for p in range(1, min(n // repeats, n - 1) + 1):
        length = max(least, repeats * p) - p  # matches p apart in a run of the least length
        match = (1 << n - p) - 1
        left = match if n - p >= length else 0
        for x in bits:
            match &= ~(x ^ x >> p)
            left = _long_stretches(match, length)
            if not left:
                break
        if left:
            for a, m in _stretches(left, length):
                found.setdefault((a, m + p), p)
    return sorted((a, m, p) for (a, m), p in found.items())


def looped(words: list, doc_id: int | None) -> list:
    """The words of every tenth document, told by the checksum of its id, with a loop from some word on."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * -(-(n - a) // len(unit)))[: n - a]


def without_repeats(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for a, m, p in found:
        change[a + p] += 1
        change[a + m] -= 1
    held = np.cumsum(change[:-1]) > 0
    return [w for w, gone in zip(words, held.tolist()) if not gone] if found else words


def _sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def _row(doc_id: int | None, text: str, planted: bool, least: int, repeats: int) -> tuple:
    words = text.encode().split()
    if planted:
        words = looped(words, doc_id)
    found = runs(words, least, repeats)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    kept = b" ".join(without_repeats(words, found))
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(found), *told, _sha("".join(f"{a},{m},{p}\n" for a, m, p in found).encode()), _sha(kept), kept.decode()


_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed")
_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, planted: bool = False, collapsed: bool = False, least: int = 6, repeats: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of each row: their number, the longest one, digests of all runs and of the words that are left; with ``collapsed`` these
    words too.  ``planted`` puts loops into every tenth document first."""

    def run(ids: list, rows: list[str]) -> dict:
        return dict(zip(_COLUMNS, zip(*(_row(i, t, planted, least, repeats) for i, t in zip(ids, rows)))))

    return common.per_text(common.texts(docs, key, text), run, _SCHEMA + (", collapsed string" if collapsed else ""))
