"""Support vector machines: the optimum, the kernels' maps, cross-fitted probabilities."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from vitalis.operators import models as ML
from vitalis.operators.many_models import BEND, fit_many, hinge_loss

FEATURES = ["a", "b x"]


def rings(spark, n=500, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, a, b, int(a * a + b * b + rng.gauss(0, 0.2) > 1.4), int(a - b + rng.gauss(0, 0.5) > 0.3), int(a * a * a - a + b > 0)))
    return spark.createDataFrame(rows, "id long, a double, `b x` double, ring int, line int, cubic int")


def test_hinge_is_smooth_and_a_hinge():
    z, y = np.linspace(-3, 3, 601), np.ones(601)
    loss, slope, bend = hinge_loss(z, y)
    assert np.allclose(np.gradient(loss, z)[1:-1], slope[1:-1], atol=0.02)
    assert np.all(np.abs(loss - np.maximum(0, 1 - z)) <= BEND / 2 + 1e-12)
    assert bend.max() == 1 / BEND and loss[-1] == 0.0


def test_linear_machine_is_the_optimum(spark):
    df = rings(spark).withColumn("line", F.col("line"))
    model = ML.fit("svm", df, FEATURES, "line", {"kernel": "linear", "C": 0.5})
    rows = df.collect()
    x, y = np.array([[r["a"], r["b x"]] for r in rows]), np.array([r["line"] for r in rows], float)
    margin = {r["id"]: r["svm_margin"] for r in model.transform(df).collect()}
    m = np.array([margin[r["id"]] for r in rows])
    design = np.column_stack([x, np.ones(len(x))])
    w = np.linalg.lstsq(design, m, rcond=None)[0]
    assert design @ w == pytest.approx(m, abs=1e-9)
    _, slope, _ = hinge_loss(m, y)
    gradient = design.T @ slope + np.append(w[:2] / 0.5, 0.0)
    assert np.abs(gradient).max() < 1e-3
    importance = {r.feature: r.importance for r in ML.intrinsic_importance(model, FEATURES, spark).collect()}
    assert [importance[f] for f in FEATURES] == pytest.approx(np.abs(w[:2]), abs=1e-9)


@pytest.mark.parametrize("kernel, label", [("linear", "line"), ("rbf", "ring"), ("poly", "cubic")])
def test_kernels_learn_and_are_calibrated(spark, tmp_path, kernel, label):
    df, fresh = rings(spark), rings(spark, 400, 9)
    model = ML.fit("svm", df, FEATURES, label, {"kernel": kernel, "C": 1.0, "gamma": "scale"})
    out = ML.predict(model, fresh, FEATURES).collect()
    truth = {r["id"]: r[label] for r in fresh.collect()}
    right = np.mean([r["prediction"] == truth[r["id"]] for r in out])
    assert right > {"linear": 0.85, "rbf": 0.85, "poly": 0.7}[kernel]
    prob = np.array([r["prob"] for r in out])
    y = np.array([truth[r["id"]] for r in out])
    assert ((prob >= 0) & (prob <= 1)).all() and abs(prob.mean() - y.mean()) < 0.08
    sure = np.clip(prob, 1e-6, 1 - 1e-6)
    loss = -np.mean(np.where(y == 1, np.log(sure), np.log(1 - sure)))
    assert loss < -(y.mean() * math.log(y.mean()) + (1 - y.mean()) * math.log(1 - y.mean()))
    model.write().overwrite().save(str(tmp_path / kernel))
    back = ML.predict(PipelineModel.load(str(tmp_path / kernel)), fresh, FEATURES).collect()
    assert {r["id"]: r["prob"] for r in back} == pytest.approx({r["id"]: r["prob"] for r in out})


def test_sketch_approximates_the_polynomial_kernel(spark):
    x = np.random.default_rng(1).normal(size=(6, 2))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, `b x` double")
    stage = ML.maclaurin_transformer(FEATURES, 0.5, 3, 4000, 7)
    z = np.array([[r[f"_map{j}"] for j in range(4000)] for r in stage.transform(df).collect()])
    want = (0.5 * x @ x.T) ** 3
    assert np.abs(z @ z.T - want).max() < 0.35 * np.abs(want).max()


def test_what_cannot_be_fitted(spark):
    df = rings(spark, 40)
    with pytest.raises(ValueError, match="one class"):
        ML.fit("svm", df.withColumn("line", F.lit(1)), FEATURES, "line", {"kernel": "linear"})
    with pytest.raises(ValueError, match="kernel"):
        ML.fit("svm", df, FEATURES, "line", {"kernel": "sigmoid"})


def test_features_without_information_converge_in_few_passes(spark):
    """No row bends at the start, so the hinge has no curvature there; a weak penalty then sends Newton's step far off."""
    rng = random.Random(8)
    rows = [(1, float(rng.random() < 0.25), rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(1500)]
    table = spark.createDataFrame(rows, "mask long, y double, x0 double, x1 double").cache()
    fitted, = fit_many(table, 2, [1e7], 20, 1e-9, hinge_loss, most_curvature=1 / BEND)
    assert fitted.converged
    x, y = np.array([[r[2], r[3], 1.0] for r in rows]), np.array([r[1] for r in rows])
    _, slope, _ = hinge_loss(x @ np.append(fitted.coefficients, fitted.intercept), y)
    assert np.abs(x.T @ slope).max() < 1e-3


@pytest.mark.parametrize("kernel", ["rbf", "poly"])
def test_map_inside_the_tasks_is_the_pipelines(spark, kernel):
    x = np.random.default_rng(4).normal(size=(5, 2))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, `b x` double")
    stage, made = ((ML.rff_transformer(FEATURES, 0.7, 30, 5), ML.rff_features(2, 0.7, 30, 5)) if kernel == "rbf" else
                   (ML.maclaurin_transformer(FEATURES, 0.7, 3, 30, 5), ML.maclaurin_features(2, 0.7, 3, 30, 5)))
    want = np.array([[r[f"_{'rff' if kernel == 'rbf' else 'map'}{j}"] for j in range(30)] for r in stage.transform(df).collect()])
    assert made(x) == pytest.approx(want, abs=1e-12)


def test_a_thin_hessian_leads_to_the_same_machine(spark, monkeypatch):
    """Of many rows a wide Hessian is estimated on a part; loss and gradient are of all rows, so the minimum is the same."""
    from vitalis.operators import many_models as MM

    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 2))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=3000) > 0).astype(float)
    df = spark.createDataFrame([(1, float(b), *map(float, a)) for a, b in zip(x, y, strict=True)],
                               "mask long, y double, x0 double, x1 double").repartition(2).cache()
    args = dict(tolerance=1e-12, losses=MM.hinge_loss, features=ML.rff_features(2, 0.5, 20), mapped=20, most_curvature=2.0)
    whole, = MM.fit_many(df, 2, [1.0], **args)
    picked = []
    keep = MM._sums
    monkeypatch.setattr(MM, "_sums", lambda *a: picked.append(a[5]) or keep(*a))
    monkeypatch.setattr(MM, "CURVED", 1000)
    thin, = MM.fit_many(df, 2, [1.0], rows=3000, **args)
    assert set(picked) == {3} and thin.converged and thin.n == whole.n == 3000
    assert thin.coefficients == pytest.approx(whole.coefficients, abs=1e-4)
    df.unpersist()
