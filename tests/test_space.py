"""Distances, parts, intervals and neighbours against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import graphs, grids, neighbours, ranges, volumes


def test_aligned_blocks_tile_the_interval(spark):
    rnd = random.Random(1)
    given = [(a, a + rnd.randrange(-2, 3000)) for a in [rnd.randrange(-5000, 5000) for _ in range(300)]] + [(0, 0), (-1, 0), (-8, 7), (5, 4), (1 << 40, (1 << 40) + 5), (None, 3), (3, None)]
    rows = spark.createDataFrame(given, "lo long, hi long").select("lo", "hi", ranges.aligned_blocks(F.col("lo"), F.col("hi")).alias("b")).collect()
    for r in rows:
        if r.lo is None or r.hi is None:
            assert not r.b
            continue
        held = sorted(x for b in r.b for x in range(b.block << b.level, (b.block + 1) << b.level))
        assert held == list(range(r.lo, r.hi + 1)) and len(r.b) <= 2 * max(1, (r.hi - r.lo + 2).bit_length())


def test_range_join_and_overlaps(spark):
    rnd = random.Random(2)
    points = [(i, rnd.choice("ab"), rnd.choice([rnd.randrange(-300, 300), 7])) for i in range(200)] + [(900, "a", None), (901, None, 5)]
    spans = [(j, rnd.choice("ab"), a, a + rnd.choice([-1, 0, 3, 500])) for j, a in enumerate(rnd.randrange(-300, 300) for _ in range(100))] + [(800, "a", None, 5), (801, "a", 0, 1 << 50)]
    p = spark.createDataFrame(points, "i int, k string, at long")
    s = spark.createDataFrame(spans, "j int, k string, lo long, hi long")
    joined = ranges.range_join(p, s, "at", "lo", "hi", ["k"])
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in joined._jdf.queryExecution().executedPlan().toString()
    want = sorted((i, j) for i, k, at in points for j, k2, lo, hi in spans if k == k2 and None not in (at, lo, hi, k) and lo <= at <= hi)
    assert sorted((r.i, r.j) for r in joined.collect()) == want
    q = s.select(F.col("j").alias("m"), "k", F.col("lo").alias("b0"), F.col("hi").alias("b1"))
    met = ranges.overlaps(s.filter("hi >= lo"), q.filter("b1 >= b0"), ("lo", "hi"), ("b0", "b1"), ["k"])
    good = [x for x in spans if None not in x and x[3] >= x[2]]
    assert sorted((r.j, r.m) for r in met.collect()) == sorted((a[0], b[0]) for a in good for b in good if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])
    assert ranges.range_join(p, s.limit(0), "at", "lo", "hi", ["k"]).collect() == []


def test_lower_envelope():
    rnd = random.Random(3)
    for _ in range(300):
        at = sorted(rnd.sample(range(-30, 30), rnd.randrange(1, 12)))
        height = [rnd.choice([0.0, rnd.random() * 20]) for _ in at]
        unit, bound = rnd.choice([0.5, 1.0, 2.0]), rnd.choice([4.0, 25.0])
        got = dict(grids.lower_envelope(at, height, unit, bound))
        want = {p: min((unit * (p - a)) ** 2 + h for a, h in zip(at, height)) for p in range(-60, 60)}
        assert got == pytest.approx({p: v for p, v in want.items() if v <= bound})


def test_distance_transform(spark):
    rnd = random.Random(4)
    sites = {(rnd.choice("ab"), *(rnd.randrange(12) for _ in range(3))) for _ in range(30)}
    asked = [(rnd.choice("abc"), *(rnd.randrange(-2, 14) for _ in range(3))) for _ in range(300)]
    names, spacing = ["x", "y", "z"], [0.5, 1.0, 0.7]
    frame = lambda rows: spark.createDataFrame(list(rows), "v string, x int, y int, z int")
    got = {tuple(r)[:4]: r.d2 for r in grids.near(frame(asked).distinct(), frame([*sites, ("a", None, 1, 1)]), ["v"], names, spacing, 2.5).collect()}
    for k in set(asked):
        d = min((sum(((a - b) * s) ** 2 for a, b, s in zip(k[1:], p[1:], spacing)) for p in sites if p[0] == k[0]), default=None)
        assert (got[k] is None and (d is None or d > 6.25)) or got[k] == pytest.approx(d)
    assert grids.squared_distances(frame(sites).limit(0), ["v"], names, spacing, 2.0).collect() == []


def plain_parts(cells):
    left, sizes = set(cells), []
    while left:
        todo, n = [left.pop()], 0
        while todo:
            x, y, z = todo.pop()
            n += 1
            for d in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)):
                p = (x + d[0], y + d[1], z + d[2])
                if p in left:
                    left.remove(p)
                    todo.append(p)
        sizes.append(n)
    return sorted(sizes)


@pytest.mark.parametrize("depth", [1, 2, 50])
def test_parts_across_slabs(spark, depth):
    rnd = random.Random(5)
    cells = {c: {(rnd.randrange(9), rnd.randrange(9), rnd.randrange(12)) for _ in range(n)} for c, n in (("a", 320), ("b", 500), ("c", 1))}
    cells["snake"] = {(x, 2 * k, z) for k in range(6) for x, z in [(i, 0) for i in range(8)]} | {(0 if k % 2 else 7, 2 * k + 1, 0) for k in range(5)}
    rows = [(k, *p) for k, v in cells.items() for p in v]
    found = grids.parts(spark.createDataFrame(rows + rows[:50] + [("a", None, 1, 1)], "k string, x int, y int, z int"), ["k"], depth=depth)
    got = found.collect()
    for k, v in cells.items():
        assert sorted(r.n for r in got if r.k == k) == plain_parts(v)
    largest = {r.k: (r.n_parts, r.largest, r.present) for r in grids.largest_part(found, ["k"], 2.0, 50).collect()}
    assert largest["c"] == (1, 1, False) and largest["snake"] == (1, 53, True)


def test_components_of_a_long_path(spark):
    edges = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(150)] + [("z1", "z2"), ("z2", "z1"), ("z3", "z3")]
    got = {r.node: r.label for r in graphs.components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert got == {f"n{k:03d}": "n000" for k in range(151)} | {"z1": "z1", "z2": "z1"}


def test_stored_volumes(spark):
    a = np.zeros((5, 4, 3), "<i2")
    a[0, 0, :2] = 7
    a[0, 1, 0] = 7
    a[4, 3, 2] = 7
    a[2, 2, 2] = 9
    df = spark.createDataFrame([("p", [5, 4, 3], a.tobytes()), ("empty", [1, 1, 1], b"\0\0")], "case_id string, shape array<int>, voxels binary")
    cells = grids.voxels(df, "case_id", planes=2)
    assert sorted((r.label, r.z, r.y, r.x) for r in cells.collect()) == [(7, 0, 0, 0), (7, 0, 0, 1), (7, 0, 1, 0), (7, 4, 3, 2), (9, 2, 2, 2)]
    assert sorted((r.label, r.n) for r in grids.parts(cells, ["case_id", "label"], depth=2).collect()) == [(7, 1), (7, 3), (9, 1)]


@pytest.mark.parametrize("block", [4, 1000])
def test_nearest_of_many(spark, block):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(60, 3)).round(1), rng.normal(size=(45, 3)).round(1) * 2 + 1
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)] + [(99, None)], "i int, v array<double>")
    centres = spark.createDataFrame([(f"c{j:02d}", v.tolist()) for j, v in enumerate(b)], "c string, w array<double>")
    d = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    got = {r.i: (r.nearest, r.d2) for r in neighbours.nearest_of_many(rows, "i", "v", centres, "c", "w", block).collect()}
    assert {i: n for i, (n, _) in got.items()} == {i: f"c{d[i].argmin():02d}" for i in range(60)}
    assert all(got[i][1] == pytest.approx(d[i].min()) for i in range(60))
    own = ((a[:, None] - a[None]) ** 2).sum(axis=2) + np.diag([np.inf] * 60)
    self_ = {r.i: r.d2 for r in neighbours.nearest_of_many(rows, "i", "v", rows, "i", "v", block, others=True).collect()}
    assert self_ == pytest.approx({i: own[i].min() for i in range(60)})
    assert neighbours.nearest_of_many(rows, "i", "v", centres.limit(0), "c", "w", block).collect() == []
    few = spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(b)], "label int, centre array<double>")
    for bound in (10, 1000):
        assert {r.i: r.d2 for r in volumes.nearest(rows.dropna(), "i", "v", few, "label", bound).collect()} == pytest.approx({i: d[i].min() for i in range(60)})


def test_near_by_tiles_is_one_shuffle_a_side(spark, monkeypatch):
    """The line passes spread every site over all places around it, in a shuffle for each axis: near_structure did not end on 1 GB."""
    rnd = random.Random(7)
    monkeypatch.setattr(grids, "_SIDE", 8)
    sites = [(rnd.choice("ab"), *(rnd.randrange(-20, 20) for _ in range(3))) for _ in range(150)] + [(None, 1, 1, 1)]
    asked = [(rnd.choice("abc"), *(rnd.randrange(-25, 25) for _ in range(3))) for _ in range(400)] + [("a", None, 1, 1), (None, 1, 1, 1)]
    frame = lambda rows: spark.createDataFrame(rows, "v string, x int, y int, z int")
    names, spacing = ["x", "y", "z"], [0.5, 1.0, 0.7]
    found = grids.near(frame(asked).distinct(), frame(sites), ["v"], names, spacing, 3.5)
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    got = {tuple(r)[:4]: r.d2 for r in found.collect()}
    for k in set(asked):
        d = min((sum(((a - b) * s) ** 2 for a, b, s in zip(k[1:], p[1:], spacing)) for p in sites if p[0] == k[0] and None not in k + p), default=None)
        assert (got[k] is None and (d is None or d > 12.25)) or got[k] == pytest.approx(d)
    assert grids.near(frame(asked * 2), frame(sites * 2), ["v"], names, spacing, 3.5).count() == 2 * len(asked)
    monkeypatch.setattr(grids, "_CELLS", 1)  # a bound of too many voxels goes by lines
    assert {tuple(r)[:4]: r.d2 for r in grids.near(frame(asked).distinct(), frame(sites), ["v"], names, spacing, 3.5).collect()} == pytest.approx(got)


@pytest.mark.parametrize("whole", [0, 300, 10_000])
def test_parts_of_small_labels_are_no_graph(spark, whole, monkeypatch):
    """Every label went through slabs and a graph: largest_parts did not end on 1 GB of labels of some hundred voxels."""
    rnd = random.Random(8)
    cells = {(c, m): {(rnd.randrange(-4, 5), rnd.randrange(9), rnd.randrange(12)) for _ in range(n)} for c, m, n in (("a", 1, 320), ("b", 1, 500), ("b", 2, 100), (None, 1, 200), ("c", 1, 1))}
    rows = [(*k, *p) for k, v in cells.items() for p in v]
    calls = []
    monkeypatch.setattr(grids, "components", lambda *a: calls.append(a) or graphs.components(*a))
    got = grids.parts(spark.createDataFrame(rows + rows[:1], "k string, m int, x int, y int, z int"), ["k", "m"], depth=2, whole=whole).collect()
    for k, v in cells.items():
        if whole == 10_000 or k[0]:
            own = [r for r in got if (r.k, r.m) == k]
            assert sorted(r.n for r in own) == plain_parts(v) and all(tuple(r.part)[::-1] in v for r in own)
    assert bool(calls) == (whole < 10_000)


def test_sums_of_open_intervals_form_no_pairs(spark):
    """Every pair of a point and an interval that holds it was a row: open_spans did not end on 0.1 GB."""
    rnd = random.Random(9)
    points = [(i, rnd.choice("ab"), rnd.choice([rnd.randrange(-3000, 3000), 7])) for i in range(200)] + [(900, "a", None), (901, None, 5), (902, "a", 1 << 49)]
    spans = [(rnd.choice("ab"), a, a + rnd.choice([-1, 0, 3, 500]), rnd.randrange(9)) for a in (rnd.randrange(-3000, 3000) for _ in range(200))] + [("a", None, 5, 1), ("a", 0, 1 << 50, None), (None, 0, 9, 1)]
    p, s = spark.createDataFrame(points, "i int, k string, at long"), spark.createDataFrame(spans, "k string, lo long, hi long, w int")
    found = ranges.held(p, s, "at", "lo", "hi", {"n": F.lit(1), "w": F.col("w")}, ["k"])
    inside = {i: [w for k2, lo, hi, w in spans if k == k2 and None not in (k, at, lo, hi) and lo <= at <= hi] for i, k, at in points}
    assert {r.i: (r.n, r.w) for r in found.collect()} == {i: (len(v), sum(x or 0 for x in v)) for i, v in inside.items()}
    assert {r.n for r in ranges.held(p, s.limit(0), "at", "lo", "hi", {"n": F.lit(1)}, ["k"]).collect()} == {0}
    crowd = spark.range(20_000).select(F.lit(0).alias("lo"), F.col("id").alias("hi"))  # 200 million pairs
    many = ranges.held(spark.range(20_000), crowd, "id", "lo", "hi", {"n": F.lit(1).cast("long")})
    assert many.agg(F.sum("n")).first()[0] == 20_000 * 20_001 // 2


def test_overlaps_are_counted_without_pairs(spark):
    """Every pair of overlapping intervals was a row, and blocks were broadcast: overlapping_spans took the driver's memory on 0.1 GB."""
    rnd = random.Random(10)
    make = lambda n: [(j, rnd.choice("ab"), a, a + rnd.choice([-1, 0, 3, 60, 500])) for j, a in enumerate(rnd.randrange(-900, 900) for _ in range(n))] + [(800, "a", None, 5), (801, None, 0, 5)]
    left, right = make(120), [*make(90), (803, "b", 2000, 1 << 40)]
    l_, r_ = spark.createDataFrame(left, "i int, k string, lo long, hi long"), spark.createDataFrame(right, "j int, k string, b0 long, b1 long")
    found = ranges.overlap_summary(l_, r_, ("lo", "hi"), ("b0", "b1"), "i", "j", ["k"])
    want = {}
    for i, k, lo, hi in left:
        met = [j for j, k2, b0, b1 in right if k == k2 and None not in (k, lo, b0) and lo <= hi and b0 <= b1 and lo <= b1 and b0 <= hi]
        if met:
            want[i] = len(met), min(met)
    assert {r.i: (r.n, r.least) for r in found.collect()} == want
    assert ranges.overlap_summary(l_, r_.limit(0), ("lo", "hi"), ("b0", "b1"), "i", "j", ["k"]).collect() == []
    n = 5000
    all_ = spark.range(n).select("id", F.lit(0).alias("lo"), F.lit(9).alias("hi"))  # 25 million pairs
    many = ranges.overlap_summary(all_, all_.select(F.col("id").alias("j"), "lo", "hi"), ("lo", "hi"), ("lo", "hi"), "id", "j")
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and [tuple(r) for r in many.agg(F.min("n"), F.max("n"), F.max("least"), F.count("*")).collect()] == [(n, n, 0, n)]
