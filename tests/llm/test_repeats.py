"""Operator 5 against brute force over all windows."""

import hashlib
import random

import numpy as np
import pytest

from factloom.llm import repeats
from factloom.llm.run_index import RunIndex


def plain(rows, length):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        if i is not None:
            for p in range(len(raw) - length + 1):
                w = raw[p : p + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            if i is not None and first[raw[p : p + length]] < i:
                gone[p : p + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((str(i), len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = prose(20), prose(60)
    rows = [None, "", "x" * 300, "x" * 120, "ab" * 90, passage, base, base, prose(40)]
    rows += [prose(rng.randint(0, 20)) + " " + passage[rng.randint(0, 30) :] + " " + prose(rng.randint(0, 20)) for _ in range(30)]
    for _ in range(15):
        near = base.split(" ")
        for _ in range(rng.randint(1, 4)):
            near[rng.randrange(len(near))] = rng.choice(words)
        rows.append(" ".join(near) + rng.choice(["", " " + passage]))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("most, seed", [(4_000, 1), (3, 2), (1, 3)])  # few variants of an anchor, and many that are dealt out anew
def test_removes_what_brute_force_removes(spark, most, seed):
    rows = corpus(seed) + [(None, "x" * 300), (3, None)]
    rows += [rows[10], rows[10]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_bytes int")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df, most=most).drop("kept").collect())
    assert got == plain(rows, 50)
    assert sum(r[2] for r in got) > 3000


def test_common_passages_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "LOT", 2_000)
    monkeypatch.setattr(repeats, "PIECE", 500)
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df, grams=(8, 30), most=5).drop("kept").collect())
    assert got == plain(rows, 50)


def test_a_long_text(spark):
    rng = random.Random(5)
    long_text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(300_000))
    rows = [(1, long_text[900_000:900_400]), (2, long_text), (3, "é" + long_text)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (0, 0) and got[2][0] >= 400 and got[3] == (len(long_text), 1)


def test_empty(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert repeats.remove_repeats(df.limit(0)).count() == 0
    assert repeats.remove_repeats(df).head().n_removed == 0


def test_index_streams_matches_from_its_samples():
    rng = random.Random(3)
    for length in (1, 4, 7, 50):
        strings = [bytes(rng.choice(b"ab\xc3") for _ in range(rng.randint(0, length + 40))) for _ in range(20)]
        strings += strings[:4] + [b"a" * 60] * 3
        index = RunIndex(strings)
        text = b"".join(s + b"\xff" for s in strings)
        assert len(index.first) < 0.9 * len(text)
        ends = [p for p, c in enumerate(text) if c == 255]
        order = sorted(range(len(text)), key=lambda p: ([c + 1 for c in text[p : next(x for x in ends if x >= p)]] + [0], p))
        above = dict(zip(order[1:], order))
        shared = {}
        for p, q in above.items():
            n = 0
            while text[p + n] == text[q + n] != 255:
                n += 1
            shared[p] = n
        place, neighbour = index.matches(length)
        assert dict(zip(place.tolist(), neighbour.tolist())) == {p: above[p] for p in above if shared[p] >= length}
        docs = [rng.randint(0, 50) for _ in strings]
        want = [[min(d for s, d in zip(strings, docs) if x[p : p + length] in s) for p in range(len(x) - length + 1)] for x in strings]
        assert [f.tolist() for f in repeats.first_documents(strings, np.array(docs), length)] == want


def test_anchors_depend_on_their_windows_only():
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 100, 500).astype(np.uint8)
    place, first, last, h = repeats.anchors(raw, 50, 22)
    assert first[0] == 0 and last[-1] == 450 and (first[1:] == last[:-1] + 1).all()
    own = np.repeat(place, last - first + 1)
    for p in (0, 17, 200, 450):
        a = repeats.anchors(raw[p : p + 50], 50, 22)[0]
        assert own[p] == a[0] + p
