"""A run-compressed Burrows-Wheeler transform of many short strings, with sampled run ends, and its matching statistics."""

from __future__ import annotations

import numpy as np

PLACES = 20  # bits of a text place; two ranks and a place fit one number
_MASK = np.int64((1 << PLACES) - 1)
_FIRST = 5  # bytes of the first round


class RunIndex:
    """Index of UTF-8 strings of fewer than 2^20 bytes in all, each string's end counting as a mark of its own below all bytes.

    Kept are the runs of the transform: head byte and first row, and, sampled, the text places of both ends of each run.  A
    run's first place has the place above it, the last of the run before, as its neighbour in the suffix order, and shares
    ``common`` bytes with it.  Inside a run both move on together: one place further in the text the neighbour is one place
    further too and they share one byte less.  So the samples alone give every place's neighbour and match length.
    """

    def __init__(self, strings: list[bytes]):
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.stop = np.cumsum(size + 1) - 1  # places of the end marks
        n = int(self.stop[-1]) + 1 if len(strings) else 0
        if n >= 1 << PLACES:
            raise ValueError(f"{n} bytes in one index")
        # UTF-8 has no bytes above 0xF4, so byte + 1 fits a byte and 0 is free for the end marks
        text = np.frombuffer(b"\xff".join(strings) + b"\xff" if strings else b"", np.uint8) + np.uint8(1)
        self.to_end = np.repeat(self.stop, size + 1) - np.arange(n)
        order, ranks = _sorted_suffixes(text, self.to_end, int(size.max(initial=0)) + 1)
        before = text[order - 1]  # the byte before the first place is the last end mark's
        opens = np.ones(n, bool)
        opens[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)  # end marks differ from each other
        self.first = np.flatnonzero(opens)
        self.head = before[self.first]
        self.sample_first = order[self.first]
        self.sample_last = order[np.append(self.first[1:], n) - 1] if n else order
        self.common = np.zeros(len(self.first), np.int64)
        if n:
            self.common[1:] = _common(text, self.to_end, ranks, self.sample_first[1:], self.sample_last[:-1])

    def matches(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, neighbour) of all places whose match with their neighbour above is ``length`` bytes or longer.

        The matching statistics are streamed from sample to sample: a stretch of the text has as many such places as its
        match length exceeds ``length``, until the next sample begins.
        """
        if not len(self.first):
            return self.first, self.first
        by_place = np.argsort(self.sample_first[1:], kind="stable")
        place, above, common = self.sample_first[1:][by_place], self.sample_last[:-1][by_place], self.common[1:][by_place]
        # the top row's place begins a stretch as well, one without a neighbour
        edges = np.sort(self.sample_first)
        ends = np.append(edges, len(self.to_end))[np.searchsorted(edges, place) + 1]
        count = np.clip(np.minimum(ends - place, common - length + 1), 0, None)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(place, count) + step, np.repeat(above, count) + step

    def lowest(self, value: np.ndarray, length: int) -> np.ndarray:
        """For each place with ``length`` bytes to its right the least value of the strings that hold those bytes."""
        place, above = self.matches(length)
        root = np.arange(len(self.to_end), dtype=np.int32)
        root[place] = above
        while True:  # up the chain of neighbours to its top, by doubling
            up = root[root]
            if (up == root).all():
                break
            root = up
        windows = np.flatnonzero(self.to_end >= length)
        own = value[np.searchsorted(self.stop, windows)]
        low = np.full(len(root), np.iinfo(np.int64).max)
        np.minimum.at(low, root[windows], own)
        return low[root[windows]]


def _sorted_suffixes(text: np.ndarray, to_end: np.ndarray, longest: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The suffix order by prefix doubling, equal suffixes in order of place, and the ranks by each prefix length."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), {}
    key = np.zeros(n, np.int64)
    for j in range(_FIRST):  # the first bytes as one number, zeros after the end mark
        key <<= 8
        key[: n - j] |= np.where(to_end[: n - j] >= j, text[j:], 0)
    depth, ranks = _FIRST, {}
    while True:
        both = np.sort(key << PLACES | np.arange(n))
        order = both & _MASK
        both >>= PLACES
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(np.append(0, both[1:] != both[:-1]))
        ranks[depth] = rank
        if depth >= longest:
            return order, ranks
        key = rank.astype(np.int64) << PLACES
        key[: n - depth] |= np.where(to_end[: n - depth] >= depth, rank[depth:] + 1, 0)
        depth *= 2


def _common(text: np.ndarray, to_end: np.ndarray, ranks: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at a and b share, by descent over the ranks; none beyond an end mark."""
    most = np.minimum(to_end[a], to_end[b])
    got = np.zeros(len(a), np.int64)
    last = len(text) - 1
    for depth in sorted(ranks, reverse=True):
        rank = ranks[depth]
        got += depth * (rank[np.minimum(a + got, last)] == rank[np.minimum(b + got, last)])
    for _ in range(_FIRST - 1):
        got += (got < most) & (text[np.minimum(a + got, last)] == text[np.minimum(b + got, last)])
    return np.minimum(got, most)
