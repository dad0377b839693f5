"""Byte-level pre-tokenisation of many texts at once, in numpy.

The split is that of the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?O+|\\s+(?!\\S)|\\s+`` with L letters, N numbers and
O what is neither of them nor white space.  All texts of a piece are laid out in one array of code points; token starts
come from changes of class, and each token gets a 64-bit polynomial hash from prefix sums, so that Python objects are
made for words not met before only.  The hash finds a word's slot; the word kept there is compared with the token.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

LETTER, NUMBER, OTHER, SPACE, GAP = 0, 1, 2, 3, 4
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@cache
def class_table() -> np.ndarray:
    """Class of each code point, as the byte-level pre-tokeniser has it; built in strips, so that little is held at once.

    Letters and numbers that this Python's Unicode tables lack, but newer ones have, are put to the pre-tokeniser itself.
    """
    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    kinds = {"L": LETTER, "N": NUMBER}
    table = np.full(0x110000, OTHER, np.uint8)
    for at in range(0, 0x110000, 0x800):
        if 0xD800 <= at < 0xE000:
            continue
        strip = list(map(chr, range(at, at + 0x800)))
        category = list(map(unicodedata.category, strip))
        table[at : at + 0x800] = [SPACE if c.isspace() and not "\x1c" <= c <= "\x1f" else kinds.get(k[0], OTHER) for c, k in zip(strip, category)]
        lacking = "".join(c for c, k in zip(strip, category) if k == "Cn")
        newer = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", lacking)] if lacking else []
        if newer:
            probe = "".join(f"!{chr(c)}a" for c in newer)
            starts = {span[0] for _, span in ByteLevel(add_prefix_space=False).pre_tokenize_str(probe)}
            for i, c in enumerate(newer):
                table[c] = OTHER if 3 * i + 1 not in starts else NUMBER if 3 * i + 2 in starts else LETTER
    return table


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those kept between calls are bounded."""
    if len(_Powers.up) >= n:
        return _Powers.up[:n], _Powers.down[:n]
    size = max(n, 1 << 16)
    with np.errstate(over="ignore"):
        up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, _BASE))])
        down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, _INVERSE))])
    if size <= 1 << 20:
        _Powers.up, _Powers.down = up, down
    return up[:n], down[:n]


_CUT = re.compile(r"(?<=\S) (?=\S)")
PART = 250_000


def parts(texts: list[str], size: int = PART, cut: bool = True) -> Iterator[tuple[list[int], list[str]]]:
    """The texts, in order, in lots of about ``size`` code points: (place of each part's text, parts).

    Longer texts are cut before a blank between two words, where a word always begins; a run without one stays whole.
    """
    owners: list[int] = []
    held: list[str] = []
    total = 0
    for k, t in enumerate(texts):
        at = 0
        while True:
            m = _CUT.search(t, at + size) if cut and len(t) - at > 2 * size else None
            end = m.start() if m else len(t)
            owners.append(k)
            held.append(t if end - at == len(t) else t[at:end])
            total += end - at
            at = end
            if total >= size:
                yield owners, held
                owners, held, total = [], [], 0
            if at == len(t):
                break
    if held:
        yield owners, held


@dataclass
class Split:
    """Tokens of a piece: ``joined[start:end]``, their hashes, the first token of each text (one more at the end), and of each
    token which special string it is (-1: none)."""

    joined: str
    code: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    special: np.ndarray


def split(texts: list[str], specials: tuple[str, ...] = ()) -> Split:
    """Cut texts into words.  ``specials`` inside a text are tokens of their own; of two that begin at one place the longer."""
    parts, part_of_text, which = texts, None, []
    if specials and any(x in t for x in specials for t in texts):
        pattern = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")")
        parts, part_of_text = [], [0]
        for t in texts:
            got = pattern.split(t)
            parts += got[::2]
            which += [specials.index(x) for x in got[1::2]]
            part_of_text.append(len(parts))
    joined = "\0".join(parts) + "\0"
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    gaps = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    cls = class_table()[code]
    cls[gaps] = GAP
    n = len(code)
    begins = np.empty(n, bool)
    begins[0] = True
    begins[1:] = cls[1:] != cls[:-1]
    begins[gaps] = True
    space = cls == SPACE
    # the last white space before other characters: a blank joins them, anything else stands alone
    last = np.flatnonzero(space[:-1] & (cls[1:] < SPACE))
    begins[last] = True
    begins[last[code[last] == 32] + 1] = False
    for q in np.flatnonzero((code == 39) & begins).tolist():
        if q + 1 < n and cls[q + 1] == LETTER:
            two = joined[q + 1 : q + 3]
            size = 2 if two[:1] in "stmd" else 3 if two in ("re", "ve", "ll") else 0
            if size:
                begins[q + 1] = False
                if q + size < n:
                    begins[q + size] = True
    if len(gaps) > 1:
        begins[gaps[:-1] + 1] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], n)
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((code.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * up[:n], out=total[1:])
        h = (total[end] - total[start]) * down[start]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= (end - start).astype(np.uint64)
    is_gap = cls[start] == GAP
    # of the gaps, those between parts of one text are the special strings
    keep = ~is_gap
    marked = np.full(len(start), -1, np.int64)
    if part_of_text is not None:
        between = np.ones(len(parts), bool)
        between[np.array(part_of_text[1:]) - 1] = False
        inner = np.flatnonzero(is_gap)[between]
        keep[inner] = True
        marked[inner] = which
    text_gaps = gaps if part_of_text is None else gaps[np.array(part_of_text[1:]) - 1]
    start, end, h, marked = start[keep], end[keep], h[keep], marked[keep]
    first = np.concatenate([[0], np.searchsorted(start, text_gaps)])
    return Split(joined, code, start, end, h, first, marked)


class WordStore:
    """Values of words, kept by a worker between pieces: at most about ``limit`` words of up to ``longest`` code points.

    ``make(words)`` returns a count for each word and, for stores of sequences, all their items end to end.  Slots are found
    by hash; every token is then compared with the word that its slot stands for, code point by code point.
    """

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray | None]], limit: int = 1_000_000, bits: int = 21, longest: int = 64):
        self.make, self.limit, self.bits, self.longest = make, limit, bits, longest
        self.clear()

    def clear(self) -> None:
        self.slot_hash = np.zeros(1 << self.bits, np.uint32)
        self.slot_place = np.full(1 << self.bits, -1, np.int32)
        self.counts = np.zeros(1024, np.int16)
        self.offsets = np.zeros(1024, np.int32)
        self.items = np.zeros(1024, np.uint32)
        self.sizes = np.zeros(1024, np.uint8)
        self.letters_at = np.zeros(1024, np.int32)
        self.letters = np.zeros(1024, np.uint32)
        self.words = self.used = self.n_letters = 0

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        old = getattr(self, name)
        if at + len(values) > len(old):
            new = np.zeros(max(2 * len(old), at + len(values)), old.dtype)
            new[:at] = old[:at]
            setattr(self, name, new)
            old = new
        old[at : at + len(values)] = values

    def lookup(self, s: Split) -> tuple[np.ndarray, np.ndarray]:
        """For each token of ``s`` the count of its word and where its items begin in ``items``, until the next lookup."""
        if self.words > self.limit:
            self.clear()
        size = s.end - s.start
        short = size <= self.longest
        slot = (s.hash >> np.uint64(64 - self.bits)).astype(np.int64)
        place = self.slot_place[slot]
        low = s.hash.astype(np.uint32)
        missed = np.flatnonzero(((self.slot_hash[slot] != low) | (place < 0)) & short)
        if len(missed):
            uniq, where, inverse = np.unique(s.hash[missed], return_index=True, return_inverse=True)
            first = missed[where]
            n = self.words
            self._add(s, first)
            place[missed] = n + inverse
            self.slot_hash[slot[first]] = low[first]
            self.slot_place[slot[first]] = np.arange(n, self.words)
        odd = ~short
        known = np.flatnonzero(short) if odd.any() else np.arange(len(place))
        wrong = self._differ(s, known, place[known], size[known])
        odd[known[wrong]] = True
        place[odd] = 0
        counts, offsets = self.counts[place].astype(np.int64), self.offsets[place].astype(np.int64)
        if odd.any():  # long words, and those whose hash is another word's, are made for this piece alone
            at = np.flatnonzero(odd)
            own: dict[str, int] = {}
            nth = np.array([own.setdefault(s.joined[i:j], len(own)) for i, j in zip(s.start[at].tolist(), s.end[at].tolist())])
            made, items = self.make(list(own))
            counts[at] = made[nth]
            if items is not None:
                self._put("items", self.used, items)
                offsets[at] = (self.used + np.cumsum(made, dtype=np.int64) - made)[nth]
        return counts, offsets

    def _add(self, s: Split, tokens: np.ndarray) -> None:
        """Take in the words of these tokens."""
        size = s.end[tokens] - s.start[tokens]
        counts, items = self.make([s.joined[i:j] for i, j in zip(s.start[tokens].tolist(), s.end[tokens].tolist())])
        n = self.words
        self._put("counts", n, counts)
        self._put("sizes", n, size)
        self._put("letters_at", n, self.n_letters + np.cumsum(size) - size)
        self._put("letters", self.n_letters, ragged(s.code, s.start[tokens], size))
        self.n_letters += int(size.sum())
        if items is not None:
            self._put("offsets", n, self.used + np.cumsum(counts, dtype=np.int64) - counts)
            self._put("items", self.used, items)
            self.used += len(items)
        else:
            self._put("offsets", n, np.zeros(len(tokens), np.int64))
        self.words += len(tokens)

    def _differ(self, s: Split, tokens: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which of the tokens are not the words at these places."""
        wrong = self.sizes[place] != size
        good = slice(None) if not wrong.any() else np.flatnonzero(~wrong)
        same = ragged(self.letters, self.letters_at[place[good]], size[good]) == ragged(s.code, s.start[tokens[good]], size[good])
        if not same.all():
            nth = np.repeat(np.arange(len(place))[good], size[good])
            wrong[nth[~same]] = True
        return wrong


def ragged(items: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``items[o : o + c]`` of all (o, c), end to end."""
    total = np.cumsum(counts)
    if not len(total) or not total[-1]:
        return items[:0]
    kind = np.int32 if max(len(items), int(total[-1])) < 1 << 31 else np.int64
    at = np.repeat((offsets - (total - counts)).astype(kind), counts)
    at += np.arange(total[-1], dtype=kind)
    return items[at]
