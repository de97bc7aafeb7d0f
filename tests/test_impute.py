"""KNN imputation by k-d trees against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalis.operators import kdtree
from vitalis.operators import missing as M
from vitalis.operators.kdtree import Tree, nearest_donors


def brute(rows, width, k):
    """rows: (key, x0, x1, ...) -> {(key, column): [(d2, donor key, value)]}."""
    out = {}
    for r in rows:
        for c in range(width):
            if r[1 + c] is not None:
                continue
            near = []
            for d in rows:
                if d[1 + c] is None:
                    continue
                both = [i for i in range(width) if r[1 + i] is not None and d[1 + i] is not None]
                if both:
                    s = 0.0
                    for i in both:
                        s += (r[1 + i] - d[1 + i]) ** 2
                    near.append((width / len(both) * s, d[0], d[1 + c]))
            out[r[0], c] = sorted(near)[:k]
    return out


def made_up(n, width, seed, kinds):
    """Low-cardinality, copied, continuous and sparse columns; a third of the rows one vector."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        u = rng.randrange(12)
        full = {"low": float(u % 3), "copy": float(u % 3) * 2, "wide": rng.gauss(0, 100), "unit": rng.random(), "user": float(u)}
        x = [full[kind] if rng.random() > (0.25 if j else 0.1) else None for j, kind in enumerate(kinds)]
        if i % 3 == 0:
            x = [1.0] * width
            x[i % width if i % 6 else 0] = None
        rows.append((f"k{i:04d}", *x))
    return rows


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.key, r.c), []).append((r.d2, r.donor, r.value))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("kinds", [("low", "copy", "user"), ("wide", "unit", "low", "user"), ("low", "low"), ("wide", "wide", "wide", "low", "unit")])
@pytest.mark.parametrize("leaf, most_patterns", [(8, 24), (8, 0), (256, 24)])
def test_nearest_donors(spark, kinds, leaf, most_patterns):
    rows = made_up(240, len(kinds), len(kinds) + leaf, kinds)
    names = ", ".join(f"x{c} double" for c in range(len(kinds)))
    df = spark.createDataFrame(rows, f"key string, {names}").repartition(4)
    got = found(nearest_donors(df, len(kinds), 4, leaf=leaf, most_patterns=most_patterns))
    want = {k: v for k, v in brute(rows, len(kinds), 4).items() if v}
    assert set(got) == set(want)
    for key, near in want.items():
        assert [x[1:] for x in got[key]] == [x[1:] for x in near]
        assert [x[0] for x in got[key]] == pytest.approx([x[0] for x in near], rel=1e-12)


def test_imputed_table(spark):
    rows = [(1, 1.0, 2.0, "a"), (2, None, 2.5, "b"), (3, 3.0, None, "c"), (4, None, None, "d"), (5, 9.0, float("nan"), "e")]
    df = spark.createDataFrame(rows, "id long, `a.b` double, c double, t string")
    got = {r["id"]: (r["a.b"], r["c"], r["t"]) for r in M.knn_impute(df, "id", ["a.b", "c"], k=2).collect()}
    # 4 shares no column with any donor: means; 2's only comparable donor for a.b is 1
    assert got == {1: (1.0, 2.0, "a"), 2: (1.0, 2.5, "b"), 3: (3.0, 2.0, "c"), 4: (13 / 3, 2.25, "d"), 5: (9.0, 2.0, "e")}
    assert M.knn_impute(df.limit(0), "id", ["a.b", "c"]).collect() == []
    whole = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id long, x double")
    assert sorted(map(tuple, M.knn_impute(whole, "id", ["x"]).collect())) == [(1, 1.0), (2, 2.0)]
    none = spark.createDataFrame([(1, None, 1.0), (2, None, 2.0)], "id long, x double, y double")
    assert [r.x for r in M.knn_impute(none, "id", ["x", "y"]).collect()] == [None, None]


def test_tree_cuts_on_as_many_columns_as_needed():
    rng = np.random.default_rng(0)
    rows = np.stack([rng.integers(0, 2, 4000), rng.integers(0, 3, 4000), rng.random(4000)], axis=1).astype(float)
    tree = Tree(rows, [0, 1, 2], 64)
    sizes = np.bincount(tree.leaf_of(rows), minlength=tree.leaves)
    assert tree.leaves == 64 and sizes.max() <= 3 * sizes.mean()
    flat = Tree(np.ones((50, 2)), [0, 1], 8)
    assert flat.leaves == 1 and set(flat.leaf_of(np.ones((3, 2)))) == {0}


def test_pairs_grow_with_the_rows(spark, monkeypatch):
    """Ten times the rows: about ten times the distances."""
    counted = []
    for n in (3000, 30_000):
        x = F.rand(3), F.rand(4) * 5, F.when(F.rand(5) > 0.1, F.col("u"))
        df = (spark.range(n, numPartitions=4).withColumn("u", F.rand(6) * 3)
              .select(F.col("id").alias("key"), x[0].alias("x0"), x[1].alias("x1"), x[2].alias("x2")))
        total = spark.sparkContext.accumulator(0)
        meet = kdtree._meet

        def look(k, width, schema, total=total, meet=meet):
            run = meet(k, width, schema)

            def counting(visitors, donors):
                total.add(visitors.num_rows * donors.num_rows)
                return run(visitors, donors)
            return counting
        monkeypatch.setattr(kdtree, "_meet", look)
        nearest_donors(df, 3, 5).count()
        monkeypatch.setattr(kdtree, "_meet", meet)
        counted.append(total.value)
    assert counted[1] < 16 * counted[0]
