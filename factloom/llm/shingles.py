"""Word shingles of many texts at once, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

from .words import _powers

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_MIX = np.uint64(0xBF58476D1CE4E5B9)
LONG = 32  # bytes of a word


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """For each text its distinct k-word shingles as sorted 64-bit keys; fewer words make one shingle of all.

    The five high bits of a key fall with the shingle's length, so that shingles of long, hence rare, words come first in
    the order of the keys and phrases of short, common words last.
    """
    joined = "\n".join(texts).encode()
    raw = _LOWER[np.frombuffer(joined, np.uint8)]
    sizes = np.array([len(t.encode()) for t in texts], np.int64)
    stop = np.cumsum(sizes + 1) - 1
    n = len(raw)
    if not n:
        return [np.zeros(0, np.uint64) for _ in texts]
    blank = _BLANK[raw]
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * up[:n], out=total[1:])
        h = (total[end] - total[start]) * down[start]
        h = (h ^ h >> np.uint64(32)) * _MIX
        h ^= h >> np.uint64(29)
        length = end - start
        for i in np.flatnonzero(length > LONG).tolist():  # sums of powers modulo 2^64 are alike for some long words
            h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
        first = np.concatenate([[0], np.searchsorted(start, stop)])
        m = max(0, len(start) - k + 1)
        key = np.zeros(m, np.uint64)
        chars = np.zeros(m, np.int64)
        for i in range(k):
            key = (key ^ h[i : i + m]) * _MIX
            key ^= key >> np.uint64(31)
            chars += length[i : i + m]
        key = _ranked(key, chars)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(key[a : b - k + 1]))
        elif b > a:
            digest = hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest()
            out.append(_ranked(np.frombuffer(digest, np.uint64), np.array([int(length[a:b].sum())])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _ranked(key: np.ndarray, chars: np.ndarray) -> np.ndarray:
    return key >> np.uint64(5) | (np.uint64(31) - np.minimum(chars // 2, 31).astype(np.uint64)) << np.uint64(59)


def bitmap(keys: np.ndarray) -> np.ndarray:
    """The OR of one bit for each shingle, two to four bits a shingle, as 64-bit words."""
    width = 256
    while width < 2 * len(keys):
        width *= 2
    bits = np.zeros(width, np.uint8)
    bits[(keys & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(data: bytes, words: int) -> np.ndarray:
    """A bitmap brought to fewer words: places are taken modulo the new width."""
    bits = np.frombuffer(data, np.uint64)
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits
