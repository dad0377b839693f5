"""Operator 12, LM scoring: a hierarchical Pitman-Yor model of word pairs.

Each context (the word before, or the text's beginning) has a restaurant whose dishes are the words that follow it; all restaurants
share one parent, in which every table below is a customer, over a uniform base of V + 1 words.  The seating is sampled by Gibbs
(``seating``): a sweep draws the tables of all dishes of all contexts given the parent, then those of the parent; dishes of one
restaurant see each other's tables as the sweep before left them, as in distributed samplers.  After ``burn`` sweeps, predictive
probabilities are averaged over ``samples`` sweeps.  Discounts come from the dishes with one and two customers, d = n1 / (n1 + 2 n2).

Spark deals everything out in packed rows.  Texts are cut into pieces of many documents; a piece asks the word buckets for ids and
counts of its distinct words, then the restaurant buckets for its distinct pairs, and gets answers in the order it asked.  Buckets
are as many as the tokens need (``per_bucket``); a restaurant with over ``share`` customers is dealt out in shares by dish, whose
tables are summed by key.  A word or pair is asked for once a piece, so a word that is a third of all tokens weighs as much as any
other.  Words are told apart by 64-bit digests.  A row's work grows with its text; a dish takes the same
work however many customers it has.

Null and empty texts are a single end token.  Rows without doc_id are training rows (the checksum of no digits is 0); repeated rows
count and are scored each.  Without training tokens every probability is that of the base.  An empty table gives an empty result;
other columns are not read; texts are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words
from .seating import distinct_pairs, draw_tables, pack, unpack


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LETTER = np.random.default_rng(12).integers(1, 1 << 63, 256).astype(np.uint64)
#: No word has these digests, but for one in 2^63.
END, BEGIN = 1, 2


def _digests(rows: list[str], lot: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A digest of every word of the texts, A-Z in lower case, and the number of words of each text.

    Digests are polynomials in the word's bytes, taken from prefix sums over lots of texts, and mixed.
    """
    found, sizes = [], np.zeros(len(rows), np.int64)
    at = 0
    while at < len(rows):
        to, size, held = at, 0, []
        while to < len(rows) and (not held or size < lot):
            held.append(rows[to].encode().lower())
            size += len(held[-1]) + 1
            to += 1
        raw = np.frombuffer(b"\n" + b"\n".join(held) + b"\n", np.uint8)
        space = _SPACE[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        first, last = edge[::2], edge[1::2]
        up, down = words._powers(len(raw) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_LETTER[raw] * up[:-1], out=total[1:])
            h = (total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        found.append(h)
        ends = np.cumsum([len(x) + 1 for x in held])
        sizes[at:to] = np.diff(np.searchsorted(first, ends, "right"), prepend=0)
        at = to
    return np.concatenate(found) if found else np.zeros(0, np.uint64), sizes


@dataclass(frozen=True)
class Model:
    """``strength``: of the contexts' and the parent's restaurants; ``steps``: of the walk of dishes of many customers in a sweep."""

    burn: int = 2
    samples: int = 3
    steps: int = 4
    strength: tuple[float, float] = (1.0, 1.0)
    folds: int = 5
    held: int = 1
    seed: int = 0
    per_bucket: int = 1 << 21
    share: int = 1 << 19
    chars: int = 8_000_000


def held_out(doc_id: int | None, folds: int = 5, held: int = 1) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == held


# --- pieces

_PIECE = "piece long, ids array<long>, n_tokens long, n_train long, begin long, end long, sizes binary, held binary, tokens binary, keys binary, counts binary"


def _schema(df: DataFrame, ddl: str) -> pa.Schema:
    return pa.schema(common._arrow_fields(df.sparkSession, ddl))


def _piece(ids: list, rows: list[str], m: Model) -> dict:
    """The piece's tokens as places among its sorted distinct keys, which are digests of words."""
    found, sizes = _digests(rows)
    sizes += 1
    every = np.full(int(sizes.sum()) + 1, END, np.uint64)
    every[-1] = BEGIN
    inner = np.ones(len(every), bool)
    inner[np.cumsum(sizes) - 1] = inner[-1] = False
    every[inner] = found
    keys, tokens = np.unique(every, return_inverse=True)
    tokens = tokens[:-1]
    held = np.array([held_out(i, m.folds, m.held) for i in ids], bool)
    counts = np.bincount(tokens[~np.repeat(held, sizes)], minlength=len(keys))
    begin, end = np.searchsorted(keys, np.array([BEGIN, END], np.uint64)).tolist()
    return {"ids": ids, "n_tokens": len(tokens), "n_train": int(counts.sum()), "begin": begin, "end": end, "sizes": pack(sizes), "held": pack(held.astype(np.int64)), "tokens": pack(tokens), "keys": keys.tobytes(), "counts": pack(counts)}


def _pieces(docs: DataFrame, m: Model) -> DataFrame:
    schema = _schema(docs, _PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for ids, rows in common.pieces(batch, m.chars):
                yield pa.RecordBatch.from_pylist([{"piece": number} | _piece(ids, rows, m)], schema=schema)
                number += 1

    return docs.mapInArrow(run, _PIECE)


def _slices(part: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """(part, the arrays' items that fall into it) of ascending parts; items of a part keep their order."""
    order = np.argsort(part, kind="stable")
    parts, first = np.unique(part[order], return_index=True)
    for p, a, b in zip(parts.tolist(), first.tolist(), [*first[1:].tolist(), len(part)]):
        yield p, *(x[order[a:b]] for x in arrays)


def _rows(table: pa.Table, order: str | None = None) -> list[dict]:
    return (table.sort_by(order) if order and table.num_rows > 1 else table).to_pylist()


def _mapped(df: DataFrame, fn, ddl: str) -> DataFrame:
    """A row at a time, to any number of rows."""
    schema = _schema(df, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        for batch in batches:
            for k in range(batch.num_rows):
                for row in fn(batch.slice(k, 1).to_pylist()[0]):
                    yield pa.RecordBatch.from_pylist([row], schema=schema)

    return df.mapInArrow(run, ddl)


def _met(left: DataFrame, right: DataFrame, key: str, fn, ddl: str) -> DataFrame:
    """``fn(rows of left, rows of right)`` of each key, to rows."""
    schema = _schema(left, ddl)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        common.trim()
        return pa.Table.from_pylist(list(fn(_rows(a), _rows(b))), schema=schema)

    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(run, ddl)


# --- words

_WORDS = "piece long, bucket long, ids binary, counts binary, known long"


def _ask_words(row: dict, buckets: int) -> Iterator[dict]:
    keys, counts = np.frombuffer(row["keys"], np.uint64), unpack(row["counts"])
    edges = np.array([-(-(k << 64) // buckets) for k in range(1, buckets)], np.uint64)
    at = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    for k in range(buckets):
        if at[k] < at[k + 1]:
            yield {"bucket": k, "piece": row["piece"], "keys": keys[at[k] : at[k + 1]].tobytes(), "counts": pack(counts[at[k] : at[k + 1]])}


def _count_words(rows: list[dict], buckets: int) -> Iterator[dict]:
    """Ids, from 1 on (0: not in training), by falling count; they tell the bucket: id = rank * buckets + bucket + 1."""
    keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
    every, nth = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.zeros(len(every), np.int64)
    np.add.at(counts, nth, np.concatenate([unpack(r["counts"]) for r in rows]))
    known = (counts > 0) | (every == np.uint64(BEGIN))
    order = np.lexsort((every, -counts, ~known))
    ids = np.zeros(len(every), np.int64)
    ids[order] = np.arange(len(every)) * buckets + rows[0]["bucket"] + 1
    ids[~known] = 0
    at = 0
    for k, (r, own) in enumerate(zip(rows, keys)):
        mine = nth[at : at + len(own)]
        at += len(own)
        yield {"piece": r["piece"], "bucket": r["bucket"], "ids": pack(ids[mine]), "counts": pack(counts[mine]), "known": int((counts > 0).sum()) if k == 0 else 0}


# --- pairs

class _Pairs:
    """A piece with its words' ids and counts: its distinct pairs of known words, in the order they are asked for."""

    def __init__(self, piece: dict, answers: list[dict], buckets: int, m: Model):
        answers = sorted((a for a in answers if a["ids"] is not None), key=lambda a: a["bucket"])
        self.ids = np.concatenate([unpack(a["ids"]) for a in answers])
        self.counts = np.concatenate([unpack(a["counts"]) for a in answers])
        begin, end = piece["begin"], piece["end"]
        self.customers = self.counts.copy()  # of a word's restaurant; that of the beginning has one for each text
        self.customers[begin], self.customers[end] = self.counts[end], 0
        self.sizes, held = unpack(piece["sizes"]), unpack(piece["held"]) > 0
        self.held = held
        self.tokens = unpack(piece["tokens"])
        self.first = np.cumsum(self.sizes) - self.sizes
        self.contexts = np.roll(self.tokens, 1)
        self.contexts[self.first] = begin
        u, w = self.ids[self.contexts], self.ids[self.tokens]
        self.both = np.flatnonzero((u > 0) & (w > 0))
        u, w, nth = distinct_pairs(u[self.both], w[self.both])
        times = np.bincount(nth, weights=~np.repeat(held, self.sizes)[self.both], minlength=len(u)).astype(np.int64)
        size = np.zeros(len(u), np.int64)
        size[nth] = self.customers[self.contexts[self.both]]
        shares = 1 + size // m.share
        with np.errstate(over="ignore"):
            share = (w.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % shares
            mixed = (u.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + share.astype(np.uint64) * np.uint64(0x165667B19E3779F9)) >> np.uint64(33)
        bucket = (mixed % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.nth = nth
        self.u, self.w, self.times, self.split, self.bucket = (x[self.order] for x in (u, w, times, shares > 1, bucket))
        self.words = np.sort(self.ids[self.ids > 0])  # a key's id is its own


_ASKED = "kind string, bucket long, piece long, a binary, b binary, c binary, d binary"


def _ask_pairs(pieces: list[dict], answers: list[dict], buckets: int, m: Model) -> Iterator[dict]:
    p = _Pairs(pieces[0], answers, buckets, m)
    for k, u, w, n, split in _slices(p.bucket, p.u, p.w, p.times, p.split):
        yield {"kind": "pair", "bucket": k, "piece": pieces[0]["piece"], "a": pack(u), "b": pack(w), "c": pack(n), "d": pack(np.unique(u[split]))}
    for k, w in _slices((p.words - 1) % buckets, p.words):
        yield {"kind": "word", "bucket": k, "piece": pieces[0]["piece"], "a": pack(w), "b": None, "c": None, "d": None}


# --- restaurants

_LEAF = "bucket long, u binary, w binary, c binary, t binary, once_w binary, once_n binary, contexts binary, once_u binary, n1 long, n2 long, t_sum binary, kept array<binary>, split array<struct<u:long,t:long>>"


def _counted(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a bucket, their training counts, and which of them each asked pair is."""
    u, w, nth = distinct_pairs(*(np.concatenate([unpack(r[x]) for r in rows]) for x in "ab"))
    c = np.bincount(nth, weights=np.concatenate([unpack(r["c"]) for r in rows]), minlength=len(u)).astype(np.int64)
    return u, w, c, nth


def _open_restaurants(rows: list[dict]) -> Iterator[dict]:
    """Dishes with one customer have one table for good: they are kept as counts by context and by word."""
    u, w, c, _ = _counted(rows)
    u, w, c = u[c > 0], w[c > 0], c[c > 0]
    contexts, which = np.unique(u, return_inverse=True)
    once, many = c == 1, c > 1
    once_w, once_n = np.unique(w[once], return_counts=True)
    once_u = np.bincount(which[once], minlength=len(contexts))
    split = np.intersect1d(contexts, np.concatenate([unpack(r["d"]) for r in rows]))
    tables = np.bincount(which, minlength=len(contexts))[np.searchsorted(contexts, split)]
    yield {
        "bucket": rows[0]["bucket"], "u": pack(u[many]), "w": pack(w[many]), "c": pack(c[many]), "t": pack(np.ones(int(many.sum()), np.int64)), "once_w": pack(once_w), "once_n": pack(once_n),
        "contexts": pack(contexts), "once_u": pack(once_u), "n1": int(once.sum()), "n2": int((c == 2).sum()), "t_sum": pack(np.zeros(int(many.sum()), np.int64)), "kept": [], "split": [{"u": int(a), "t": int(b)} for a, b in zip(split, tables)],
    }


_SENT = "kind string, bucket long, sender long, a binary, b binary, more array<binary>"


def _send_tables(row: dict, buckets: int, first: bool) -> Iterator[dict]:
    """To the word buckets: the tables of each dish in this bucket; at ``first`` those of single customers too."""
    w, nth = np.unique(unpack(row["w"]), return_inverse=True)
    t = np.bincount(nth, weights=unpack(row["t"]), minlength=len(w)).astype(np.int64)
    for kind, a, b in [("many", w, t), *([("once", unpack(row["once_w"]), unpack(row["once_n"]))] if first else [])]:
        for k, x, y in _slices((a - 1) % buckets, a, b):
            yield {"kind": kind, "bucket": k, "sender": row["bucket"], "a": pack(x), "b": pack(y), "more": None}


_PARENT = "kind string, bucket long, sender long, ids binary, once binary, c binary, t binary, n1 long, n2 long, tables long, customers long, kept array<binary>"


@dataclass(frozen=True)
class _Scale:
    """What all tasks know: discounts, the parent's customers and tables, and the number of words."""

    d: float
    d0: float
    customers: int
    tables: int
    words: int
    strength: float
    strength0: float

    def parent(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        return (c - self.d0 * t + (self.strength0 + self.d0 * self.tables) / (self.words + 1)) / (self.strength0 + self.customers)


def _recount(state: list[dict], sent: list[dict], m: Model, scale: _Scale | None, sweep: int, keep: bool) -> Iterator[dict]:
    """The parent's dishes of one bucket: their customers are the tables below.  Answers each sender with customers and tables."""
    bucket = (state or sent)[0]["bucket"]
    pairs = {k: [(unpack(r["a"]), unpack(r["b"])) for r in sent if r["kind"] == k] for k in ("many", "once")}
    if state:
        ids, once = unpack(state[0]["ids"]), unpack(state[0]["once"])
    else:
        ids = np.unique(np.concatenate([a for x in pairs.values() for a, _ in x]))
        once = np.zeros(len(ids), np.int64)
        for a, n in pairs["once"]:
            once[np.searchsorted(ids, a)] += n
    c = once.copy()
    for a, n in pairs["many"]:
        c[np.searchsorted(ids, a)] += n
    if scale is None:
        t = np.ones(len(ids), np.int64)
    else:
        rng = np.random.default_rng([m.seed, sweep, bucket, 1])
        before = unpack(state[0]["t"])
        t = draw_tables(c, np.minimum(before, c), scale.tables - before, np.full(len(c), 1 / (scale.words + 1)), scale.d0, scale.strength0, m.steps, rng, sweep == 0)
    kept = (state[0]["kept"] if state else []) + ([pack(c), pack(t)] if keep else [])
    none = dict.fromkeys(("n1", "n2", "tables", "customers"))
    yield {"kind": "state", "bucket": bucket, "sender": None, "ids": pack(ids), "once": pack(once), "c": pack(c), "t": pack(t), "n1": int((c == 1).sum()), "n2": int((c == 2).sum()), "tables": int(t.sum()), "customers": int(c.sum()), "kept": kept}
    for r in sent:
        if r["kind"] == "many":
            at = np.searchsorted(ids, unpack(r["a"]))
            yield {"kind": "reply", "bucket": bucket, "sender": r["sender"], "ids": None, "once": None, "c": pack(c[at]), "t": pack(t[at]), "kept": None} | none


def _tables_of_contexts(row: dict, contexts: np.ndarray, which: np.ndarray, t: np.ndarray) -> np.ndarray:
    return unpack(row["once_u"]) + np.bincount(which, weights=t, minlength=len(contexts)).astype(np.int64)


def _resample(leaf: list[dict], replies: list[dict], m: Model, scale: _Scale, buckets: int, sweep: int, keep: bool) -> Iterator[dict]:
    """The tables of a bucket's dishes, given their probabilities in the parent."""
    row = leaf[0]
    u, w, c, before, contexts = (unpack(row[x]) for x in ("u", "w", "c", "t", "contexts"))
    which = np.searchsorted(contexts, u)
    tables = _tables_of_contexts(row, contexts, which, before)
    for x in row.get("shared") or []:  # shares of the restaurant in other buckets count too
        tables[np.searchsorted(contexts, x["u"])] = x["t"]
    dishes = np.unique(w)
    p = np.zeros(len(dishes))
    if len(dishes):
        replies = sorted((r for r in replies if r["c"] is not None), key=lambda r: r["bucket"])
        p[np.argsort((dishes - 1) % buckets, kind="stable")] = np.concatenate([scale.parent(unpack(r["c"]), unpack(r["t"])) for r in replies])
    rng = np.random.default_rng([m.seed, sweep, row["bucket"], 0])
    t = draw_tables(c, before, tables[which] - before, p[np.searchsorted(dishes, w)], scale.d, scale.strength, m.steps, rng, sweep == 0)
    now = _tables_of_contexts(row, contexts, which, t)
    at = np.searchsorted(contexts, np.array([x["u"] for x in row["split"]], np.int64))
    row |= {"t": pack(t), "split": [{"u": x["u"], "t": int(n)} for x, n in zip(row["split"], now[at])]}
    if keep:
        row |= {"t_sum": pack(unpack(row["t_sum"]) + t), "kept": [*row["kept"], pack(now)]}
    row.pop("shared", None)
    yield row


# --- answers

_ANSWER = "kind string, piece long, bucket long, ids binary, counts binary, more array<binary>"


def _answer_pairs(asked: list[dict], leaf: list[dict]) -> Iterator[dict]:
    """Customers and the sum of the samples' tables of each asked pair."""
    if not asked:
        return
    u, w, c, nth = _counted(asked)
    times = np.zeros(len(u), np.int64)
    times[c == 1] = len(leaf[0]["kept"])
    times[c > 1] = unpack(leaf[0]["t_sum"])
    at = 0
    for r in asked:
        n = len(unpack(r["a"]))
        mine = nth[at : at + n]
        at += n
        yield {"kind": "pair", "piece": r["piece"], "bucket": r["bucket"], "ids": None, "counts": None, "more": [pack(c[mine]), pack(times[mine])]}


def _send_contexts(row: dict, buckets: int) -> Iterator[dict]:
    contexts, kept = unpack(row["contexts"]), [unpack(x) for x in row["kept"]]
    for k, u, *tables in _slices((contexts - 1) % buckets, contexts, *kept):
        yield {"kind": "context", "bucket": k, "sender": row["bucket"], "a": pack(u), "b": None, "more": [pack(x) for x in tables]}


def _answer_words(state: list[dict], sent: list[dict], samples: int) -> Iterator[dict]:
    """Of each asked word and sample: customers and tables in the parent, and tables of its own restaurant."""
    every = np.unique(np.concatenate([unpack(r["a"]) for r in sent]))
    own = np.zeros((2 * samples, len(every)), np.int64)
    tables = np.zeros((samples, len(every)), np.int64)
    if state:
        ids = unpack(state[0]["ids"])
        at = np.searchsorted(every, ids)
        there = (at < len(every)) & (every[np.minimum(at, len(every) - 1)] == ids)
        for k, x in enumerate(state[0]["kept"]):
            own[k, at[there]] = unpack(x)[there]
    for r in sent:
        if r["kind"] == "context":
            at = np.searchsorted(every, unpack(r["a"]))
            for k, x in enumerate(r["more"]):
                tables[k, at] += unpack(x)
    for r in sent:
        if r["kind"] == "word":
            at = np.searchsorted(every, unpack(r["a"]))
            yield {"kind": "word", "piece": r["sender"], "bucket": r["bucket"], "ids": None, "counts": None, "more": [pack(x[at]) for x in (*own, *tables)]}


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(pieces: list[dict], answers: list[dict], m: Model, buckets: int, scales: list[_Scale], n_train: int, n_words: int) -> Iterator[dict]:
    piece = pieces[0]
    p = _Pairs(piece, [a for a in answers if a["kind"] == "id"], buckets, m)
    parts = {k: sorted((a for a in answers if a["kind"] == k), key=lambda a: a["bucket"]) for k in ("pair", "word")}
    s = m.samples
    join = lambda kind, k: np.concatenate([unpack(a["more"][k]) for a in parts[kind]]) if parts[kind] else np.zeros(0, np.int64)
    of_word = np.zeros((3 * s, len(p.words)), np.int64)
    order = np.argsort((p.words - 1) % buckets, kind="stable")
    for k in range(3 * s):
        of_word[k, order] = join("word", k)
    # by key of the piece; words that training has not are served from the base alone
    stats = np.zeros((3 * s, len(p.ids)), np.int64)
    stats[:, p.ids > 0] = of_word[:, np.searchsorted(p.words, p.ids[p.ids > 0])]
    c, t = np.zeros(len(p.u), np.int64), np.zeros(len(p.u), np.int64)
    if len(p.u):
        c[p.order], t[p.order] = join("pair", 0), join("pair", 1)
    scale = scales[0]
    seen = np.zeros(len(p.tokens))
    seen[p.both] = (c - scale.d * t / s)[p.nth]
    back = np.zeros(len(p.tokens))
    for k, x in enumerate(scales):
        parent = x.parent(stats[2 * k], stats[2 * k + 1])
        back += (x.strength + x.d * stats[2 * s + k])[p.contexts] * parent[p.tokens] / s
    logs = np.log10((seen + back) / (scale.strength + p.customers[p.contexts]))
    base = np.log10((p.counts + 0.5) / (n_train + 0.5 * (n_words + 1)))[p.tokens]
    known = np.add.reduceat((p.counts > 0)[p.tokens].astype(np.int64), p.first)
    for row in zip(piece["ids"], p.held.tolist(), p.sizes.tolist(), known.tolist(), np.add.reduceat(base, p.first).tolist(), np.add.reduceat(logs, p.first).tolist()):
        yield dict(zip(("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"), row)) | {"train_tokens": n_train}


def _discount(n1: int, n2: int) -> float:
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.05


def score(docs: DataFrame, model: Model = Model(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; the model learns from the other folds."""
    m, spark = model, docs.sparkSession
    pieces = common.materialise(_pieces(common.texts(docs, key, text), m), "lm-pieces")
    n_all, n_train = (x or 0 for x in pieces.agg(F.sum("n_tokens"), F.sum("n_train")).first())
    buckets = max(1, -(-n_all // m.per_bucket))
    texts = pieces.select("piece", "ids", "begin", "end", "sizes", "held", "tokens")  # once the words are asked for, their digests stay behind

    asks = _mapped(pieces.select("piece", "keys", "counts"), lambda r: _ask_words(r, buckets), "bucket long, piece long, keys binary, counts binary")
    answered = _schema(docs, _WORDS)
    count = lambda t: pa.Table.from_pylist(list(_count_words(_rows(t), buckets)), schema=answered)
    counted = common.materialise(asks.groupBy("bucket").applyInArrow(count, _WORDS), "lm-words")
    n_words = counted.agg(F.sum("known")).first()[0] or 0

    asked = common.materialise(_met(texts, counted, "piece", lambda a, b: _ask_pairs(a, b, buckets, m), _ASKED), "lm-asked")
    common.release(spark)
    leaf_schema = _schema(docs, _LEAF)
    open_ = lambda t: pa.Table.from_pylist(list(_open_restaurants(_rows(t))), schema=leaf_schema)
    leaf = common.materialise(asked.filter("kind = 'pair'").groupBy("bucket").applyInArrow(open_, _LEAF), "lm-leaf")
    sent = _mapped(leaf.select("bucket", "w", "t", "once_w", "once_n"), lambda r: _send_tables(r, buckets, True), _SENT)
    nothing = spark.createDataFrame([], _PARENT)
    parent = common.materialise(_met(nothing, sent, "bucket", lambda a, b: _recount(a, b, m, None, 0, False), _PARENT), "lm-parent")
    d = _discount(*(x or 0 for x in leaf.agg(F.sum("n1"), F.sum("n2")).first()))
    totals = lambda: [x or 0 for x in parent.agg(F.sum("customers"), F.sum("tables"), F.sum("n1"), F.sum("n2")).first()]
    customers, tables, n1, n2 = totals()
    scale = _Scale(d, _discount(n1, n2), customers, tables, n_words, *m.strength)
    scales = []
    for sweep in range(m.burn + m.samples):
        keep = sweep >= m.burn
        replies = parent.filter("kind = 'reply'").select(F.col("sender").alias("to"), "bucket", "c", "t")
        shares = leaf.select("bucket", F.explode("split").alias("s")).select("bucket", "s.*")
        shared = shares.join(shares.groupBy("u").agg(F.sum("t").alias("t_all")), "u").groupBy("bucket").agg(F.collect_list(F.struct("u", F.col("t_all").alias("t"))).alias("shared"))
        both = leaf.join(shared, "bucket", "left").withColumn("to", F.col("bucket"))
        new_leaf = common.materialise(_met(both, replies, "to", lambda a, b, s=scale, i=sweep, k=keep: _resample(a, b, m, s, buckets, i, k), _LEAF), "lm-leaf")
        sent = _mapped(new_leaf.select("bucket", "w", "t"), lambda r: _send_tables(r, buckets, False), _SENT)
        new_parent = common.materialise(_met(parent.filter("kind = 'state'"), sent, "bucket", lambda a, b, s=scale, i=sweep, k=keep: _recount(a, b, m, s, i, k), _PARENT), "lm-parent")
        common.discard(leaf, parent)
        leaf, parent = new_leaf, new_parent
        customers, tables, _, _ = totals()
        scale = _Scale(d, scale.d0, customers, tables, n_words, *m.strength)
        if keep:
            scales.append(scale)

    of_pairs = _met(asked.filter("kind = 'pair'"), leaf, "bucket", _answer_pairs, _ANSWER)
    contexts = _mapped(leaf.select("bucket", "contexts", "kept"), lambda r: _send_contexts(r, buckets), _SENT)
    wanted = asked.filter("kind = 'word'").select("kind", "bucket", F.col("piece").alias("sender"), "a", "b", F.lit(None).cast("array<binary>").alias("more"))
    of_words = _met(parent.filter("kind = 'state'"), contexts.unionByName(wanted), "bucket", lambda a, b: _answer_words(a, b, m.samples), _ANSWER)
    answers = common.materialise(of_pairs.unionByName(of_words), "lm-answers")
    common.discard(asked, leaf, parent)
    common.release(spark)
    given = answers.unionByName(counted.select(F.lit("id").alias("kind"), "piece", "bucket", "ids", "counts", F.lit(None).cast("array<binary>").alias("more")))
    return _met(texts, given, "piece", lambda a, b: _scores(a, b, m, buckets, scales, n_train, n_words), _SCORES)
