"""Byte-pair merging of words: the vocabulary, a heap with linked lists, and batched numpy rounds."""

from __future__ import annotations

import json
from functools import cache, cached_property
from heapq import heapify, heappop, heappush

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
NONE = np.int64(1 << 40)
#: Words of more bytes are merged place by place in order of rank, so that a round touches only the places of its pair.
LONG = 64


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Ids of bytes, merges as sorted pair keys, the bytes of each id, and the special strings of a byte-level file.

    Files whose settings these operators do not follow are refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model, pre = j["model"], j.get("pre_tokenizer") or {}
        set_otherwise = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if model.get("type") != "BPE" or set_otherwise or not plain or j.get("normalizer") or any(t.get(k) for t in j["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: only byte-level BPE without normaliser, prefix blank or stripping special strings is supported")
        ids: dict[str, int] = model["vocab"]
        # the printable stand-ins of bytes: printable Latin-1 stands for itself, the others follow from 256 on
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in set(own)]
        byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.byte_id = np.zeros(256, np.int64)
        for c, b in byte_of.items():
            self.byte_id[b] = ids[c]
        self.specials = tuple(t["content"] for t in j["added_tokens"])
        self.special_ids = np.array([t["id"] for t in j["added_tokens"]], np.uint32)
        self.cuttable = not any(" " in x for x in self.specials)
        self.bytes = [b""] * (1 + max([*ids.values(), *self.special_ids.tolist()]))
        if len(self.bytes) >= 1 << 20:
            raise ValueError(f"{path}: {len(self.bytes)} ids; pair keys hold ids below {1 << 20}")
        for token, i in ids.items():
            self.bytes[i] = bytes(byte_of.get(c, 63) for c in token)
        for token, i in zip(self.specials, self.special_ids.tolist()):
            self.bytes[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self.keys_in_rank, self.made_in_rank = left << 20 | right, np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(self.keys_in_rank, kind="stable")
        self.keys, self.ranks, self.made = self.keys_in_rank[order], order.astype(np.int64), self.made_in_rank[order]

    @cached_property
    def byte_ids(self) -> list[int]:
        return self.byte_id.tolist()

    @cached_property
    def keys_by_rank(self) -> list[int]:
        return self.keys_in_rank.tolist()

    @cached_property
    def rank_of(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys_by_rank, zip(range(len(self.keys)), self.made_in_rank.tolist())))

    def rank(self, key: np.ndarray) -> np.ndarray:
        """The rank of each pair key, NONE for those that do not merge."""
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def heap_count(word: bytes, v: Vocabulary) -> int:
    """Symbols left of a word: the initial ones minus the merges; no ids are written.

    A heap holds the ranked adjacent pairs, lists link neighbours; a popped pair counts only if both its symbols are
    still those it was pushed with.
    """
    n = len(word)
    if n < 2:
        return n
    rank_of = v.rank_of
    sym = list(map(v.byte_ids.__getitem__, word))
    heap = []
    for i in range(n - 1):
        got = rank_of.get(sym[i] << 20 | sym[i + 1])
        if got:
            heap.append((got[0], i, got[1]))
    if not heap:
        return n
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = v.keys_by_rank
    left = n
    while heap:
        rank, i, made = heappop(heap)
        j = after[i]
        if j >= n or sym[i] << 20 | sym[j] != pair[rank]:
            continue
        sym[i], sym[j] = made, -1
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            got = rank_of.get(made << 20 | sym[k])
            if got:
                heappush(heap, (got[0], i, got[1]))
        h = before[i]
        if h >= 0:
            got = rank_of.get(sym[h] << 20 | made)
            if got:
                heappush(heap, (got[0], h, got[1]))
    return left


def merge_rounds(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words: a count for each word, and the ids end to end."""
    is_long = np.fromiter((len(w) > LONG for w in words), bool, len(words))
    if not is_long.any():
        return _all_at_once(words, v)
    counts = np.zeros(len(words), np.int32)
    few = [w for w in words if len(w) <= LONG]
    counts[~is_long], ids = _all_at_once(few, v)
    counts[is_long], long_ids = _rank_by_rank([w for w in words if len(w) > LONG], v)
    out = np.empty(int(counts.sum(dtype=np.int64)), np.uint32)
    of_long = np.repeat(is_long, counts)
    out[~of_long], out[of_long] = ids, long_ids
    return counts, out


def _all_at_once(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Short words: the symbols of the words still open lie in one flat array.

    A round finds each pair's rank by binary search over the sorted pair keys, takes the lowest of each word, and merges all
    its places in that word, left to right.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    sym = v.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)
    done_sym, done_word = [], []
    while len(sym):
        ranks = np.append(np.where(word[1:] == word[:-1], v.rank(sym[:-1] << 20 | sym[1:]), NONE), NONE)
        begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        low = np.minimum.reduceat(ranks, begin)
        lowest = np.repeat(low, np.diff(np.append(begin, len(sym))))
        closed = lowest == NONE
        if closed.any():
            done_sym.append(sym[closed])
            done_word.append(word[closed])
            open_ = ~closed
            sym, word, ranks, lowest = sym[open_], word[open_], ranks[open_], lowest[open_]
            if not len(sym):
                break
        places = np.flatnonzero(ranks == lowest)
        places = _every_second(places, np.append(True, np.diff(places) != 1))
        sym[places] = v.made_in_rank[ranks[places]]
        keep = np.ones(len(sym), bool)
        keep[places + 1] = False
        sym, word = sym[keep], word[keep]
    if not done_sym:
        return np.zeros(len(words), np.int32), np.zeros(0, np.uint32)
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return np.bincount(word, minlength=len(words)).astype(np.int32), sym[order].astype(np.uint32)


def _every_second(places: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Of places one after another (a pair of equal symbols) the first, third ...; ``opens``: where such a row begins."""
    run = np.flatnonzero(opens)
    nth = np.arange(len(places)) - np.repeat(run, np.diff(np.append(run, len(places))))
    return places[nth % 2 == 0]


def _rank_by_rank(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Long words: all symbols in one flat array with links to the next and the one before.

    The places of each rank are kept in a batch; a round takes the lowest rank's batch, merges those places that still hold
    its pair, and looks up only the pairs that came about.  The work is that of the merges made, not of the words' length.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = int(sizes.sum())
    sym = v.byte_id[np.frombuffer(b"".join(words), np.uint8)].astype(np.int32)
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    ends = np.cumsum(sizes)
    after[ends - 1] = n
    before[(ends - sizes)] = -1
    rank = np.full(n, NONE)
    alive = np.ones(n, bool)
    batches: dict[int, list[np.ndarray]] = {}
    order: list[int] = []

    def pair(places: np.ndarray) -> None:
        """Give these places the rank of the pair that begins there."""
        rank[places] = NONE
        places = places[after[places] < n]
        rank[places] = got = v.rank(sym[places].astype(np.int64) << 20 | sym[after[places]])
        places, got = places[got < NONE], got[got < NONE]
        by_rank = np.argsort(got, kind="stable")
        places, got = places[by_rank], got[by_rank]
        cut = np.flatnonzero(np.append(True, got[1:] != got[:-1])) if len(got) else []
        for a, b in zip(cut, np.append(cut[1:], len(got))):
            r = int(got[a])
            if r not in batches:
                batches[r] = []
                heappush(order, r)
            batches[r].append(places[a:b])

    pair(np.arange(n, dtype=np.int32))
    while order:
        r = heappop(order)
        held = batches.pop(r)
        places = np.unique(np.concatenate(held)) if len(held) > 1 else held[0]
        places = places[alive[places] & (rank[places] == r)]
        if not len(places):
            continue
        if len(places) > 1:
            places = _every_second(places, np.append(True, after[places[:-1]] != places[1:]))
        gone = after[places]
        sym[places] = v.made_in_rank[r]
        alive[gone] = False
        following = after[places] = after[gone]
        inside = following < n
        before[following[inside]] = places[inside]
        left = before[places]
        pair(np.union1d(places, left[left >= 0]))
    return np.bincount(word[alive], minlength=len(words)).astype(np.int32), sym[alive].astype(np.uint32)
