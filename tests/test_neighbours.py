"""Nearest neighbours: copies, ties and blocks that grow with the table."""

import numpy as np
import pytest

from factloom.operators import neighbours


def _brute(rows, others):
    out = {}
    for i, v in rows:
        d = [(float(((np.array(v) - np.array(w)) ** 2).sum()), j) for j, w in rows if not (others and i == j)]
        out[i] = min(d)
    return out


@pytest.mark.parametrize("others", [False, True])
def test_copies_ties_and_far_rows(spark, others):
    rng = np.random.default_rng(5)
    vectors = [*rng.integers(-3, 4, (150, 3)).astype(float).tolist(), *([[1000.0, 0.0, 0.0]] * 3), [-1e6, 5.0, 5.0]]
    rows = list(enumerate(vectors))
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r.id: (r.d2, r.nearest) for r in neighbours.nearest_of_many(df, "id", "v", df, "id", "v", block=8, others=others).collect()}
    assert got == _brute(rows, others)


def test_a_table_has_a_bounded_number_of_blocks(spark):
    df = spark.range(600).selectExpr("id", "array(cast(id AS double)) AS v")
    blocks = neighbours._blocks(df, 0, 1.0, 2, 1, "q", ["id"]).collect()
    assert len(blocks) <= neighbours._PARTS and sum(len(b.q_id) for b in blocks) == 600


def test_single_precision_only_chooses(spark):
    a = np.array([[1.0, 1e-9], [1.0, 0.0]])
    b = np.array([[1.0, 3e-9], [1.0, 2e-9], [4.0, 0.0], [1.0, 2e-9]])
    row, d2, label = neighbours._nearest(np.arange(2), a, np.array([7, 9, 1, 8]), None, b)
    assert row.tolist() == [0, 1] and label.tolist() == [8, 8] and np.allclose(d2, [1e-18, 4e-18], rtol=1e-6, atol=0)
