"""Operator 2, token counts: heap-and-linked-list byte-pair merging.

A count is the initial symbols of each word minus the merges made in it; no token ids are built.  A word is merged when
a worker first meets it; later ones, compared letter by letter, take the stored count.  Texts longer than a piece are cut
between words, so memory does not grow with them.  Null texts count as empty: no bytes, no tokens.  Repeated
rows and null ids each give a row of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import bpe, common, words

def _store(path: str) -> words.WordStore:
    v = bpe.vocabulary(path)
    return common.kept("bpe counts", path, lambda: words.WordStore(lambda new: (np.array([bpe.heap_count(w.encode(), v) for w in new], np.int32), None)))


def count_texts(texts: list[str], path: str) -> np.ndarray:
    v, store = bpe.vocabulary(path), _store(path)
    total = np.zeros(len(texts), np.int64)
    for owners, rows in words.parts(texts, cut=v.cuttable):
        s = words.split(rows, v.specials)
        counts, _ = store.lookup(s)
        upto = np.concatenate([[0], np.cumsum(np.where(s.special >= 0, 1, counts), dtype=np.int64)])
        np.add.at(total, owners, np.diff(upto[s.first]))
    return total


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row; over_limit: more than ``limit`` tokens."""
    path = vocabulary or bpe.vocabulary_path()

    def count(ids: list, rows: list[str]) -> dict:
        n = count_texts(rows, path)
        return {"doc_id": ids, "n_bytes": [len(t.encode()) for t in rows], "n_tokens": n, "over_limit": n > limit}

    return common.per_text(common.texts(docs, key, text), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
