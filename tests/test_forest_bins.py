"""Forests on many rows: rows of equal bins together, classes looked up."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from vitalis.operators import forest_bins as B
from vitalis.operators import models as ML
from vitalis.operators.tree_shapley import forest_nodes


def made_rows(spark, n=4000, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = float(rng.randrange(20)), float(rng.randrange(6)), float(rng.randrange(4))
        rows.append((f"k{i}", a, b, c, int(rng.random() < 0.1 + 0.04 * a - 0.1 * (b > 3) + 0.05 * c * (a > 10))))
    return spark.createDataFrame(rows, "id string, `a.x` double, b double, c double, y int").repartition(3)


FEATURES = ["a.x", "b", "c"]


def test_one_tree_is_sparks_tree(spark):
    """Without a bootstrap and with all features a tree has the cuts, counts and merged leaves of Spark's."""
    data = ML._prepare(made_rows(spark), FEATURES, "y").select(*[F.col(f"`{f}`") for f in FEATURES], "label")
    _, binned, bounds, cells = ML.binned_rows(data, FEATURES)
    blocks = cells.mapInArrow(B.packed(3), B.PACKED).cache()
    made = B.grow(blocks, 3, max(map(len, bounds)) + 1, 2, 1, 5, 4, 3, 42, bootstrap=False)
    model = B.as_model(spark, made, bounds, 2, RandomForestClassifier(numTrees=1, maxDepth=5, minInstancesPerNode=4))
    plain = data.toDF("a", "b", "c", "label")
    spark_tree = DecisionTreeClassifier(maxDepth=5, minInstancesPerNode=4).fit(
        VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(plain))

    assert model.trees[0].numNodes == spark_tree.numNodes and model.trees[0].depth == spark_tree.depth
    assert model.featureImportances.toArray() == pytest.approx(spark_tree.featureImportances.toArray(), abs=1e-9)
    x = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(plain)
    one = [(r.prediction, *r.probability) for r in model.transform(x).collect()]
    two = [(r.prediction, *r.probability) for r in spark_tree.transform(x).collect()]
    assert np.array(one) == pytest.approx(np.array(two), abs=1e-12)
    blocks.unpersist()


def test_forest_on_cells(spark, monkeypatch):
    """From ``MANY_ROWS`` on a forest is grown from cells: as many trees, about the same probabilities, the same twice."""
    df = made_rows(spark)
    params = {"trees": 60, "depth": 5}
    plain = ML.fit("forest", df, FEATURES, "y", params, key="id")
    monkeypatch.setattr(ML, "MANY_ROWS", 1000)
    calls = []
    keep = B.fit_cells
    monkeypatch.setattr(B, "fit_cells", lambda *a: calls.append(a[0].count()) or keep(*a))
    binned = ML.fit("forest", df, FEATURES, "y", params, key="id")
    assert calls and calls[0] <= 20 * 6 * 4 * 2  # no more rows than different bins and labels
    last = binned.stages[-1]
    assert isinstance(last, RandomForestClassificationModel) and last.getNumTrees == 60 and last.getMaxDepth() == 5
    one = {r.id: r.prob for r in ML.predict(plain, df, FEATURES, key="id").collect()}
    two = {r.id: r.prob for r in ML.predict(binned, df, FEATURES, key="id").collect()}
    gaps = [abs(one[k] - two[k]) for k in one]
    assert len(two) == 4000 and sum(gaps) / len(gaps) < 0.02
    assert last.featureImportances.toArray() == pytest.approx(plain.stages[-1].featureImportances.toArray(), abs=0.06)
    again = ML.fit("forest", df, FEATURES, "y", params, key="id")
    assert {r.id: r.prob for r in ML.predict(again, df, FEATURES, key="id").collect()} == two
    roots = [r[0]["stats"] for r in forest_nodes(last).values()]  # a bootstrap: about as many rows, not the same in each tree
    sizes = [sum(s) for s in roots]
    assert abs(np.mean(sizes) - 4000) < 60 and 30 < np.std(sizes) < 110  # of Poisson(4000), sqrt(4000) = 63
    torn = df.withColumn("b", F.when(F.col("id") != "k7", F.col("b")))
    with pytest.raises(Exception, match="missing or infinite"):
        ML.fit("forest", torn, FEATURES, "y", params, key="id")


def test_open_nodes_in_parts(spark, monkeypatch):
    """Trees whose open nodes do not fit at once are the same trees."""
    data = ML._prepare(made_rows(spark, 1500), FEATURES, "y").select(*[F.col(f"`{f}`") for f in FEATURES], "label")
    _, _, bounds, cells = ML.binned_rows(data, FEATURES)
    blocks = cells.coalesce(2).mapInArrow(B.packed(3), B.PACKED).cache()
    args = (blocks, 3, max(map(len, bounds)) + 1, 2, 4, 7, 1, 2, 42)
    whole = B.grow(*args)
    monkeypatch.setattr(B, "MOST_NODES", 5)
    parts = B.grow(*args)
    for a, b in zip(whole, parts, strict=True):
        assert a.feature == b.feature and a.cut == b.cut and a.left == b.left
        assert [list(s) for s in a.stats] == [list(s) for s in b.stats]
    blocks.unpersist()


def test_classes_looked_up(spark, monkeypatch):
    """The importance by a forest's decision table is that of its predictions, missing values included."""
    df = made_rows(spark, 2500)
    model = ML.fit("forest", df, FEATURES, "y", {"trees": 7, "depth": 6}, key="id")
    test = df.withColumn("b", F.when(F.crc32("id") % 9 != 0, F.col("b"))).withColumn(
        "y", F.when(F.crc32("id") % 11 != 0, F.col("y")))
    want = [tuple(r) for r in ML.permutation_importance(model, test, FEATURES, "y", "id", 3).collect()]
    monkeypatch.setattr(ML, "MANY_ROWS", 1000)
    monkeypatch.setattr(ML, "_copies_right", None)  # not used any more
    got = [tuple(r) for r in ML.permutation_importance(model, test, FEATURES, "y", "id", 3).collect()]
    assert [g[0] for g in got] == [w[0] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[1:] == pytest.approx(w[1:], abs=1e-12)
    monkeypatch.setattr(B, "MOST_CELLS", 10)
    assert B.decision_table(model.stages[-1], 3) is None
