"""Operator 7 against all pairs, on words, sizes and groups of every kind."""

import random
import re

import numpy as np
import pytest

from factloom.llm import common, components, jaccard_join, shingles


def plain_set(text, k):
    found = re.findall(common.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + k]) for i in range(len(found) - k + 1)} if len(found) >= k else {tuple(found)} if found else set()


def plain_components(rows, k, share):
    sets = [(i, plain_set(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and i is not None and j is not None and 100 * len(x & y) >= share * len(x | y):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return sorted((str(i), len(s), str(None if i is None else root(i))) for i, s in sets)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(400)] + ["É", "É x", "ß"]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    passage = prose(25)
    texts = [None, "", " \n", "one", "One", "one two", "one two", "a b c", "A b\tc"]
    for size in (4, 12, 30, 60, 120):
        for _ in range(3):
            base = prose(size)
            chain = list(base)
            for _ in range(rng.randint(1, 14)):
                near = list(rng.choice([base, chain]))
                for _ in range(rng.randint(0, max(1, size // 20))):
                    near[rng.randrange(len(near))] = rng.choice(words)
                near = near[: len(near) - rng.choice([0, 0, 1, 2])]
                chain = near
                texts.append(rng.choice([" ", "\n", "  "]).join(near))
    texts += [" ".join(prose(rng.randint(0, 30)) + passage + prose(rng.randint(0, 30))) for _ in range(40)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("k, share", [(3, 90), (5, 80)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, k, share):
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)  # groups of many blocks
    monkeypatch.setattr(jaccard_join, "SPAN", 3)
    rows = corpus(k) + [(None, "one two"), (None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_shingles int")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.join(df, k, share).collect())
    assert got == plain_components(rows, k, share)
    kept = sorted(str(r.doc_id) for r in jaccard_join.keep_one(df, k, share).collect())
    assert kept == sorted(i for i, _, c in got if i == c)


def test_a_group_of_near_copies_gives_fewer_links_than_rows(spark):
    """Copies that differ from one text in a tenth of their words differ from each other in twice that: no hub links them all."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(900)]
    base = [rng.choice(words) for _ in range(80)]
    rows = []
    for i in range(220):
        near = list(base)
        for _ in range(rng.randint(0, 5)):
            near[rng.randrange(len(near))] = rng.choice(words)
        rows.append((i, " ".join(near)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    members, edges = jaccard_join.links(df, 3, 90)
    assert edges.count() < 5 * len(rows)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.join(df, 3, 90).collect())
    assert got == plain_components(rows, 3, 90)


def test_long_words_are_told_apart():
    s = "a"
    for _ in range(11):
        s += s.translate(str.maketrans("ab", "ba"))
    one, two = shingles.shingle_sets([s, s.translate(str.maketrans("ab", "ba"))], 3)
    assert one.tolist() != two.tolist()


def test_a_long_text(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    long_text = " ".join(rng.choice(words) for _ in range(250_000))
    rows = [(7, long_text), (3, long_text[:-40] + "z"), (9, long_text[: len(long_text) // 2])]
    got = {r.doc_id: r.component_id for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == {7: 3, 3: 3, 9: 9}


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.join(df, 3, 90).collect())) == [(1, 4, 1), (1, 4, 1), (2, 4, 1)]
    assert jaccard_join.join(df.limit(0), 3, 90).count() == 0


def test_traversal_drops_no_pair_that_links():
    rng = np.random.default_rng(1)
    for share in (50, 80, 90):
        sets = []
        for _ in range(8):
            base = rng.integers(0, 1 << 62, rng.integers(1, 300), dtype=np.uint64)
            for _ in range(rng.integers(1, 30)):
                drop = rng.random(len(base)) < rng.random() * 0.15
                sets.append(np.unique(np.concatenate([base[~drop], rng.integers(0, 1 << 62, drop.sum(), dtype=np.uint64), base[:1]])))
        sets.sort(key=len)
        maps = [shingles.bitmap(s).tobytes() for s in sets]
        bits, size = np.array([shingles.folded(m, min(map(len, maps)) // 8) for m in maps]), np.array([len(s) for s in sets])
        tree = jaccard_join.Tree(bits, size)
        found = {(int(a), int(b)) for p, q in jaccard_join.dual_traversal(tree, tree, share) for a, b in zip(p, q)}
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                both = len(np.intersect1d(x, y))
                if 100 * both >= share * (len(x) + len(y) - both):
                    assert (a, b) in found
        assert len(found) < len(sets) ** 2 / 2


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 200) for i in range(20)] + [(5, 5)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(20)} | {200: 100}
