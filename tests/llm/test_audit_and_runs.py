"""Operators 11 and 13 against plain versions, and their odd rows."""

import hashlib
import random
import zlib
from itertools import permutations

import pytest

import __spark_entry__ as entry
from conftest import SF
from factloom.llm import filter_audit, periodic
from test_registered import rows  # noqa: F401

LABELS = "doc_id long, quality int, toxic int"


def plain_audit(docs, labels):
    """Every order applied to every document, one after the other."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    seen = {}
    for i, t, _ in docs:
        if i is not None:
            seen[t or ""] = min(seen.get(t or "", i), i)
    fails = []
    for i, t, part in docs:
        t = t or ""
        w = t.encode().split()
        bad = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in t for c in "#$%&*|"), i is not None and i > seen[t]]
        fails.append((part or "", dict(zip("ABCDE", bad)), i in good, i in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            own = [f for f in fails if f[0] == part]
            left = own
            for step, x in enumerate(order, 1):
                gone = [f for f in left if f[1][x]]
                left = [f for f in left if not f[1][x]]
                failing = sum(f[1][x] for f in own)
                removed_by[x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(f[1][x] and sum(f[1].values()) == 1 for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return out


def audited(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_audit_of_odd_rows(spark):
    rnd = random.Random(3)
    prose = " ".join(f"w{k}" for k in range(60))
    docs = [(1, prose, "a"), (2, prose, "b"), (2, prose, "b"), (3, None, None), (4, "", ""), (None, prose, "a"), (None, "", "b"), (7, prose.upper(), "a"), (8, prose + " #", "a"), (9, "x " * 70, "a"), (10, "é  " * 60, "b"), (11, "w " * 100_000, "c")]
    docs += [(20 + k, rnd.choice([prose, "Short Text", "a b " * 40]), rnd.choice("abc")) for k in range(40)]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (9, None, 1), (None, 1, 1), (99, 1, 1), *((20 + k, k % 2, k % 3 == 0) for k in range(30))]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    table = spark.createDataFrame([(i, t, p, 5, "c") for i, t, p in docs], "doc_id long, text string, source string, n int, part string")
    want = plain_audit(docs, labels)
    have = audited(filter_audit.audit(table, spark.createDataFrame(labels, LABELS)))
    assert have == want and len(have) == 600 * 4  # parts: a, b, c and the empty string
    assert audited(filter_audit.audit(table.limit(0), spark.createDataFrame(labels, LABELS))) == {}
    assert audited(filter_audit.audit(table, spark.createDataFrame([], LABELS))) == plain_audit(docs, [])


def test_edges_and_steps():
    edges, steps = filter_audit.edges("ABCDE"), filter_audit.steps("ABCDE")
    assert len(set(edges)) == 80 and len(steps) == 600 and {(b, k) for _, _, b, k in steps} == set(edges)


def plain_runs(words, least=6, repeats=4):
    """Every period and start, and the smallest period of what they give."""
    n, out = len(words), []
    for q in range(1, n):
        i = 0
        while i < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, repeats * q) and not any(all(words[k] == words[k + r] for k in range(i, i + length - r)) for r in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def test_runs_against_every_period():
    rnd = random.Random(1)
    for _ in range(1500):
        words = [rnd.randrange(rnd.choice([1, 2, 3, 5])) for _ in range(rnd.randrange(60))]
        unit = words[: rnd.randrange(1, 9)]
        words = words[: rnd.randrange(6)] + unit * rnd.randrange(9) + words[:3]
        for least, repeats in ((6, 4), (1, 2), (10, 3)):
            assert periodic.runs(words, least, repeats) == plain_runs(words, least, repeats)
    assert periodic.runs(["a"] * 5) == [] and periodic.runs(["a"] * 6) == [(0, 6, 1)] and periodic.runs([]) == []
    with pytest.raises(ValueError):
        periodic.runs(["a"] * 9, repeats=1)


def test_many_stretches_of_one_lag_and_a_long_loop():
    words = [w for k in range(200) for w in ["a"] * (6 + k % 3) + [f"w{k}"]]
    assert periodic.runs(words) == plain_runs(words)[:] and len(periodic.runs(words)) == 200
    loop = [f"w{k}" for k in range(5000)]
    assert periodic.runs(["x", *loop * 4, "y"]) == [(1, 20000, 5000)]


def expected_row(i, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(b"" if i is None else str(i).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    found = plain_runs(words) if n < 400 else periodic.runs(words)
    gone = {k for a, m, p in found for k in range(a + p, a + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda s: hashlib.sha256(s).hexdigest()
    return i, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join("%d,%d,%d\n" % r for r in found).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in gone))


def test_registered_runs(spark, rows):  # noqa: F811
    have = [tuple(r) for r in entry.queries()["op13_periodic_runs"](spark, SF).collect()]
    want = [expected_row(i, t) for i, t in rows]
    assert sorted(have) == sorted(want) and any(r[1] for r in have)


def test_runs_of_odd_rows(spark):
    docs = [(1, None), (None, "a a a a a a a"), (2, ""), (3, "             "), (4, "a b " * 30_000), (4, "x y z " * 4)]
    table = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, collapsed string")
    have = periodic.periodic_runs(table, collapsed=True).collect()
    by = {(r.doc_id, r.length): r for r in have}
    assert len(have) == 6 and by[1, None].n_runs == 0 and by[None, 7].collapsed == "a" and by[2, None].collapsed == ""
    assert by[3, 6].collapsed == " " and by[4, 60_000].collapsed == "a b" and by[4, 12].collapsed == "x y z" and by[4, 12].exponent_milli == 4000
    assert periodic.periodic_runs(table.limit(0)).collect() == []
