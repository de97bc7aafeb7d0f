"""Keyed permutations of ranks, and permutation importance by them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalis.functions.rng import permuted_rank, permuted_ranks, unit_hash
from vitalis.operators import models as ML


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_bijection(spark, n):
    for name in ("perm-0", "perm-1"):
        got = {r.id: r.p for r in spark.range(n).select("id", permuted_rank(F.col("id"), n, 7, name).alias("p")).collect()}
        assert sorted(got.values()) == list(range(n))
        assert [got[i] for i in range(n)] == permuted_ranks(n, 7, name)


def test_permutations_look_random():
    n = 5000
    a, b = np.array(permuted_ranks(n, 42, "perm-0")), np.array(permuted_ranks(n, 42, "perm-1"))
    for p in (a, b):
        assert abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.05
        assert abs(np.corrcoef(p[:-1], p[1:])[0, 1]) < 0.05
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.05


def test_importance_by_hand(spark):
    rng = np.random.default_rng(3)
    rows = [(f"k{i}", float(rng.normal()), float(rng.normal()), 1.0) for i in range(300)]
    rows = [(k, a, b, c, int(a + 0.3 * b > 0)) for k, a, b, c in rows]
    df = spark.createDataFrame(rows, "id string, a double, `b.x` double, c double, y int")

    def model(d):
        return d.withColumn("prediction", F.when(F.col("a") + 0.3 * F.col("`b.x`") > 0, 1.0).otherwise(0.0))

    got = {r.feature: (r.importance, r["std"]) for r in
           ML.permutation_importance(model, df, ["a", "b.x", "c"], "y", "id", repeats=3, seed=5).collect()}
    u = {r.id: r.u for r in df.select("id", unit_hash(F.col("id"), 5, "perm-base").alias("u")).collect()}
    order = sorted(rows, key=lambda r: (u[r[0]], r[0]))
    for j, f in enumerate(["a", "b.x", "c"]):
        acc = []
        for rep in range(3):
            p = permuted_ranks(300, 5, f"perm-{rep}")
            right = 0
            for i, r in enumerate(order):
                x = list(r[1:4])
                x[j] = order[p[i]][1 + j]
                right += (x[0] + 0.3 * x[1] > 0) == bool(r[4])
            acc.append(right / 300)
        assert got[f] == pytest.approx((1.0 - np.mean(acc), np.std(acc)), abs=1e-12)
    assert got["c"] == (0.0, 0.0)
    assert ML.permutation_importance(model, df.limit(0), ["a", "b.x", "c"], "y", "id").collect() == []


def test_forest_keeps_no_node_ids_and_rows_go_by_rank(spark, monkeypatch):
    from vitalis.operators import models as ML

    for kind in ("forest", "boost"):
        assert not ML.build_pipeline(kind, ["a"], {}, 10).getStages()[-1].getCacheNodeIds()
    written = {}
    keep = ML.materialised
    monkeypatch.setattr(ML, "materialised", lambda df, label: written.setdefault(label, keep(df, label)))
    df = spark.createDataFrame([(f"key-{i}", float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(60)], "id string, a double, b double, y int")
    ML.permutation_importance(lambda t: t.withColumn("prediction", (t["a"] > 3).cast("double")), df, ["a", "b"], "y", "id").collect()
    assert set(written["ranked"].columns) == {"a", "b", "label", "_pos"}
