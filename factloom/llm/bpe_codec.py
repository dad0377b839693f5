"""Operator 6, BPE encoding and decoding: batched numpy merge rounds.

The symbols of all words that a worker has not met before are merged together (``bpe.merge_rounds``); a text's ids are
gathered from the stored words.  Texts longer than a piece are cut between words, so memory does not grow with them.  Decoding joins the bytes of the ids; bytes that are no UTF-8 become U+FFFD.  Null texts
are empty: no ids, empty text.  Repeated rows and null ids each give a row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe, common, words

_strings: list[str] = []


def _store(path: str) -> words.WordStore:
    v = bpe.vocabulary(path)
    return common.kept("bpe ids", path, lambda: words.WordStore(lambda new: bpe.merge_rounds([w.encode() for w in new], v)))


def encode_texts(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and where each begins (one more at the end)."""
    return gather(texts, _store(path), bpe.vocabulary(path))


def gather(texts: list[str], store: words.WordStore, v: bpe.Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    found = []
    size = np.zeros(len(texts) + 1, np.int64)
    for owners, rows in words.parts(texts, cut=v.cuttable):
        s = words.split(rows, v.specials)
        counts, offsets = store.lookup(s)
        marked = s.special >= 0
        if marked.any():
            at = len(store.items)
            items = np.concatenate([store.items, v.special_ids])
            counts[marked], offsets[marked] = 1, at + s.special[marked]
        else:
            items = store.items
        found.append(words.ragged(items, offsets, counts))
        np.add.at(size, np.array(owners) + 1, np.diff(np.concatenate([[0], np.cumsum(counts)])[s.first]))
    return np.concatenate([*found, np.zeros(0, np.uint32)]), np.cumsum(size)


def decode_ids(ids: list[int], path: str) -> str:
    return b"".join(map(bpe.vocabulary(path).bytes.__getitem__, ids)).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row."""
    path = vocabulary or bpe.vocabulary_path()

    def run(keys: list, rows: list[str]) -> dict:
        ids, at = encode_texts(rows, path)
        return {"doc_id": keys, "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))}

    return common.per_text(common.texts(docs, key, text), run, "doc_id long, ids array<int>", 250_000)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give the empty text."""
    path = vocabulary or bpe.vocabulary_path()

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "text": [decode_ids(x or [], path) for x in part.column(1).to_pylist()]})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of both directions in one pass: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    path = vocabulary or bpe.vocabulary_path()

    def run(keys: list, rows: list[str]) -> dict:
        if not _strings:
            _strings.extend(map(str, range(len(bpe.vocabulary(path).bytes))))
        ids, at = encode_texts(rows, path)
        digits, decoded = [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            own = ids[a:b].tolist()
            digits.append(hashlib.sha256(",".join(map(_strings.__getitem__, own)).encode()).hexdigest())
            decoded.append(hashlib.sha256(decode_ids(own, path).encode()).hexdigest())
        return {"doc_id": keys, "n_tokens": np.diff(at), "ids_sha256": digits, "decoded_sha256": decoded}

    return common.per_text(common.texts(docs, key, text), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
