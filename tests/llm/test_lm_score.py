"""Operator 12: the sampler against the exact distribution, the model against a plain Gibbs sampler, the counts against brute force."""

import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

import __spark_entry__ as entry
from conftest import SF
from factloom.llm import lm_score, seating
from test_registered import rows  # noqa: F401


def tokens(text):
    return [*(text or "").encode().lower().split(), " "]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1


def table(spark, docs):
    return spark.createDataFrame([(i, t, 3.5, "x") for i, t in docs], "doc_id long, text string, score double, kind string")


def plain_base(docs):
    counts = Counter(w for i, t in docs if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return [(i, held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for i, t in docs]


def exact_ways(c, d):
    """log of the weight of all seatings of c customers at 0, 1, ... tables, customer by customer."""
    t, ways = np.arange(c + 1), np.full(c + 1, -np.inf)
    ways[0] = 0
    with np.errstate(divide="ignore"):
        for k in range(c):
            ways = np.logaddexp(np.log(np.maximum(k - d * t, 0)) + ways, np.append(-np.inf, ways[:-1]))
    return ways


def exact_tables(c, others, p, d, strength):
    weight = exact_ways(c, d)[1:] + np.cumsum(np.log((strength + d * (others + np.arange(c))) * p))
    weight = np.exp(weight - weight.max())
    return weight / weight.sum()


@pytest.mark.parametrize("d", [0.05, 0.3, 0.72, 0.85])
def test_ways_of_many_customers(d):
    for c in (97, 400, 1500):
        t = np.unique(np.clip(np.array([1, 2, 3, 5, 9, 20, 50, 90, 200, 380, 1000, 1490, c - 1, c]), 1, c))
        assert abs(seating.log_ways(np.full(len(t), c), t, d) - exact_ways(c, d)[t]).max() < 0.01
    assert abs(np.exp(seating._ways(d)[40, 1:41] - exact_ways(40, d)[1:]) - 1).max() < 1e-9


@pytest.mark.parametrize("c, others, p", [(2, 3, 0.2), (5, 4, 0.3), (9, 10, 0.1), (60, 500, 0.01), (97, 10, 0.3), (300, 500, 0.01), (300, 20_000, 0.01)])
def test_gibbs_steps_leave_the_exact_distribution(c, others, p):
    rng, n = np.random.default_rng(5), 20_000
    full, t = [np.full(n, x) for x in (c, others, p)], np.ones(n, np.int64)
    for sweep in range(12 if c > seating.WEIGHED else 1):
        t = seating.draw_tables(full[0], t, full[1], full[2], 0.7, 1.0, 4, rng, sweep == 0)
    want, at = exact_tables(c, others, p, 0.7, 1.0), np.arange(1, c + 1)
    mean = (want * at).sum()
    assert abs(np.bincount(t, minlength=c + 1)[1 : c + 1] / n - want).max() < 0.015
    assert t.mean() == pytest.approx(mean, rel=0.02) and t.var() == pytest.approx((want * at**2).sum() - mean**2, rel=0.1)


def test_any_number_of_customers():
    c = np.array([1, 2, 3, 10, 1000, 10**6, 10**9, 10**12])
    t = seating.draw_tables(c, np.ones(8, np.int64), np.full(8, 100), np.full(8, 0.01), 0.7, 1.0, 4, np.random.default_rng(0), True)
    assert (t >= 1).all() and (t <= np.minimum(c, 20)).all()
    assert seating.draw_tables(c[:0], c[:0], c[:0], np.zeros(0), 0.7, 1.0, 4, np.random.default_rng(0)).tolist() == []


def test_packed_arrays_and_pairs():
    for a in ([], [0], [255, 256], [1 << 40, 3], list(range(70_000))):
        assert seating.unpack(seating.pack(np.array(a, np.int64))).tolist() == a
    rng = random.Random(2)
    for big in (5, 1 << 45):
        pairs = [(rng.randrange(3) * big, rng.randrange(4)) for _ in range(50)]
        u, w, nth = seating.distinct_pairs(*(np.array(x, np.int64) for x in zip(*pairs)))
        got = list(zip(u.tolist(), w.tolist()))
        assert got == sorted(set(pairs)) and [got[k] for k in nth] == pairs


def test_closed_form_where_nothing_is_drawn(spark):
    """One training text of different words: a dish has one customer everywhere, so all tables are known."""
    train = next(i for i in range(1, 50) if not held(i))
    test = [i for i in range(1, 90) if held(i)][:3]
    docs = [(train, "A b c"), (test[0], "a b c"), (test[1], "b zz a"), (test[2], None)]
    have = {r.doc_id: r.score for r in lm_score.score(table(spark, docs)).collect()}
    d, v = 0.95, 4  # the discount of counts without twos is the highest allowed
    parent = lambda w: ((1 - d if w in "abc " else 0) + (1 + d * 4) / (v + 1)) / (1 + 4)
    follows = {"^": "a", "a": "b", "b": "c", "c": " "}

    def p(u, w):
        c = u in follows
        return ((1 - d if c and follows[u] == w else 0) + (1 + (d if c else 0)) * parent(w)) / (1 + c)

    for i, text in docs:
        words = [*(text or "").lower().split(), " "]
        assert have[i] == pytest.approx(sum(log10(p(u, w)) for u, w in zip(["^", *words], words)), abs=1e-9)


class PlainModel:
    """One customer after the other leaves and comes back, and every table at once counts in the parent."""

    def __init__(self, docs, d, d0, strength=1.0):
        self.d, self.d0, self.s = d, d0, strength
        self.rnd = random.Random(9)
        self.tables, self.parent = {}, {}
        self.people = [(u, w) for t in docs for u, w in zip(["^", *tokens(t)], tokens(t))]
        self.v = len({w for _, w in self.people})
        self.size, self.open = Counter(), Counter()
        self.customers = self.parents = 0
        for x in self.people:
            self.come(*x)

    def base(self, w):
        own = self.parent.get(w, [])
        return (sum(own) - self.d0 * len(own) + (self.s + self.d0 * self.parents) / (self.v + 1)) / (self.s + self.customers)

    def p(self, u, w):
        own = self.tables.get((u, w), [])
        return (sum(own) - self.d * len(own) + (self.s + self.d * self.open[u]) * self.base(w)) / (self.s + self.size[u])

    def pick(self, own, d, new):
        x = self.rnd.random() * (sum(own) - d * len(own) + new)
        for k, n in enumerate(own):
            x -= n - d
            if x < 0:
                own[k] += 1
                return False
        own.append(1)
        return True

    def come(self, u, w):
        self.size[u] += 1
        if self.pick(self.tables.setdefault((u, w), []), self.d, (self.s + self.d * self.open[u]) * self.base(w)):
            self.open[u] += 1
            self.customers += 1
            self.parents += self.pick(self.parent.setdefault(w, []), self.d0, (self.s + self.d0 * self.parents) / (self.v + 1))

    def go_from(self, own):
        k = self.rnd.choices(range(len(own)), own)[0]
        own[k] -= 1
        if not own[k]:
            del own[k]
            return True
        return False

    def leave(self, u, w):
        self.size[u] -= 1
        if self.go_from(self.tables[u, w]):
            self.open[u] -= 1
            self.customers -= 1
            self.parents -= self.go_from(self.parent[w])

    def scores(self, docs, burn=20, samples=60):
        kept = []
        for sweep in range(burn + samples):
            for x in self.people:
                self.leave(*x)
                self.come(*x)
            if sweep >= burn:
                kept.append([[self.p(u, w) for u, w in zip(["^", *tokens(t)], tokens(t))] for t in docs])
        return [sum(log10(sum(k[i][j] for k in kept) / samples) for j in range(len(kept[0][i]))) for i in range(len(docs))]


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(4)
    vocabulary = [f"v{k}" for k in range(40)]
    return [(i, " ".join(rnd.choices(vocabulary, [1 / (k + 1) for k in range(40)], k=rnd.randrange(5, 40)))) for i in range(150)]


def test_scores_against_a_plain_sampler(spark, corpus):
    have = {r.doc_id: r for r in lm_score.score(table(spark, corpus), lm_score.Model(burn=4, samples=12)).collect()}
    spread = {r.doc_id: r for r in lm_score.score(table(spark, corpus), lm_score.Model(burn=4, samples=12, per_bucket=500, share=100, chars=900)).collect()}
    train = [t for i, t in corpus if not held(i)]
    pairs = Counter((u, w) for t in train for u, w in zip(["^", *tokens(t)], tokens(t)))
    contexts = Counter(w for _, w in pairs)
    discount = lambda c: lm_score._discount(*(sum(n == k for n in c.values()) for k in (1, 2)))
    want = PlainModel(train, discount(pairs), discount(contexts)).scores([t for _, t in corpus])
    for (i, t), w in zip(corpus, want):
        assert have[i].score == pytest.approx(w, abs=0.03 * len(tokens(t)))
        assert spread[i].score == pytest.approx(w, abs=0.03 * len(tokens(t)))
    total = sum(want)
    assert sum(r.score for r in have.values()) == pytest.approx(total, rel=0.005) and sum(r.score for r in spread.values()) == pytest.approx(total, rel=0.005)


def test_registered_scores(spark, rows):  # noqa: F811
    have = {r.doc_id: r for r in entry.queries()["op12_lm_scoring"](spark, SF).collect()}
    assert len(have) == len(rows)
    for i, out, n, known, total, base in plain_base(rows):
        r = have[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total) and r.base_score == pytest.approx(base, abs=1e-6)
    own = [r for r in have.values() if r.held_out]
    assert sum(r.score for r in own) > 0.95 * sum(r.base_score for r in own)  # nearer to 0 than the base on unseen texts


def test_odd_rows(spark):
    docs = [(None, "a b"), (None, None), (1, ""), (1, ""), (2, "A  a b \n"), (3, "a " * 60_000), (4, None)]
    have = lm_score.score(table(spark, docs)).collect()
    want = plain_base(docs)
    key = lambda r: (str(r[0]), r[2], r[3])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in have), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6)
    assert all(np.isfinite(r.score) and r.score < 0 for r in have)
    assert lm_score.score(table(spark, docs).limit(0)).collect() == []
    alone = [(i, "x y") for i in range(60) if held(i)][:2]
    assert [r.score for r in lm_score.score(table(spark, alone)).collect()] == [0.0, 0.0]  # no training: one word, the unseen one
