"""The neighbour join: small cells on columns that go together, busy leaves, missing values, keys that repeat."""

import random

import numpy as np
import pytest

from vitalis.operators import neighbours as N
from vitalis.operators.kdtree import Tree


def brute(queries, points, k, exclude_self):
    out = {}
    for q in queries:
        if None in q[1:]:
            continue
        near = {(sum((a - b) ** 2 for a, b in zip(q[1:], p[1:], strict=True)), p[0]) for p in points
                if None not in p[1:] and not (exclude_self and p[0] == q[0])}
        out[q[0]] = sorted(near)[:k]
    return out


def joined(spark, queries, points, k, exclude_self, **more):
    schema = "id string, x double, y double, z double"
    got = {}
    for r in N.knn_join(spark.createDataFrame(queries, schema), spark.createDataFrame(points, schema), qkey="id", pkey="id",
                        features=["x", "y", "z"], k=k, exclude_self=exclude_self, **more).collect():
        got.setdefault(r.query_key, []).append((r.rank, r.d2, r.point_key))
    return {q: [(d, p) for _, d, p in sorted(v)] for q, v in got.items()}


def correlated(n, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = float(rng.randrange(400))
        rows.append((f"k{i}", x, 2 * x + rng.randrange(3), rng.random() if i % 3 else 0.0))
    return rows


def test_cells_stay_small_on_columns_that_go_together():
    """A query reaches a few leaves however many there are, and no leaf outgrows its size."""
    rng = np.random.default_rng(1)
    for n in (4_000, 32_000):
        t = rng.random(n)
        x = np.stack([1000 * t, 170 * t + rng.random(n)], axis=1)
        tree = Tree(x, [0, 1], n // 64)
        size = np.bincount(tree.leaf_of(x), minlength=tree.leaves)
        assert size.max() <= 256
        visits = sum(len(rows) for rows, _ in N._within(tree, x[:500], np.full(500, 1.0), np.ones(500)))
        assert visits <= 500 * 12


@pytest.mark.parametrize("exclude_self", [False, True])
def test_join_equals_brute_force(spark, monkeypatch, exclude_self):
    monkeypatch.setattr(N, "MOST_VISITORS", 50)  # leaves dealt to several tasks
    rows = correlated(900)
    rows += [rows[7], rows[8], ("gap", None, 1.0, 1.0), ("far", 1e9, 0.0, 0.0)]  # rows that come twice, a missing value, an outlier
    assert joined(spark, rows, rows, 6, exclude_self, target_per_cell=1) == brute(rows, rows, 6, exclude_self)


def test_few_points(spark):
    rows = correlated(3)
    assert joined(spark, rows, rows, 5, True) == brute(rows, rows, 5, True)
    assert joined(spark, rows, [], 5, False) == {}


def test_missing_coordinates_count_less(spark):
    points = [("a", 0.0, 0.0, 0.0), ("b", 1.0, None, 0.0), ("c", None, None, None), ("d", 5.0, 5.0, 5.0)]
    got = joined(spark, [("q", 0.0, 4.0, None)], points, 3, False, nan_euclidean=True)
    assert got == {"q": [(3.0, "b"), (24.0, "a"), (39.0, "d")]}
