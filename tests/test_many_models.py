"""Logistic models fitted together against fits of their own."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalis.operators import models as ML
from vitalis.operators import prep as P
from vitalis.operators.many_models import as_table, fit_many, judge_many, mask_of


def made_up(n=900, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1), rng.gauss(0, 3), rng.random(), float(rng.randrange(2))]
        z = 1.2 * x[0] - 0.4 * x[1] + 2 * x[2] - 0.7
        rows.append((i, *x, int(rng.random() < 1 / (1 + math.exp(-z)))))
    return rows


SCHEMA = "id long, a double, b double, `c.d` double, e double, y int"
FEATURES = ["a", "b", "c.d", "e"]


def single(rows, c, passes=200):
    """Newton's method on one model's rows."""
    x = np.array([[*r[1:5], 1.0] for r in rows])
    y = np.array([r[5] for r in rows], float)
    w = np.zeros(5)
    ridge = np.array([1 / c] * 4 + [0.0])
    for _ in range(passes):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-14:
            break
    return w


def test_many_equal_single_fits(spark):
    rows = made_up()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    subsets = [(lambda r, f=f, k=k: r[0] % 5 != f and r[0] < k) for f in range(5) for k in (90, 300, 500, 700, 900)]
    conditions = [(F.col("id") % 5 != f) & (F.col("id") < k) for f in range(5) for k in (90, 300, 500, 700, 900)]
    c = [0.01 * 10 ** (m % 5) for m in range(25)]
    table = as_table(df, FEATURES, "y", mask_of(conditions), mask_of([F.col("id") % 5 == f for f in range(5) for _ in range(5)]))
    table = table.cache()
    fitted = fit_many(table.select("mask", "y", "x0", "x1", "x2", "x3"), 4, c)
    assert all(m.converged and m.passes <= 12 for m in fitted)
    for m, model in enumerate(fitted):
        mine = [r for r in rows if subsets[m](r)]
        assert model.n == len(mine)
        assert np.append(model.coefficients, model.intercept) == pytest.approx(single(mine, c[m]), abs=1e-6)
    seen = judge_many(table.select(F.col("test").alias("mask"), "y", "x0", "x1", "x2", "x3"), 4, fitted)
    for m, (n, correct, positives, hits) in enumerate(seen):
        mine = [r for r in rows if r[0] % 5 == m // 5]
        says = [np.dot(r[1:5], fitted[m].coefficients) + fitted[m].intercept > 0 for r in mine]
        assert (n, positives) == (len(mine), sum(r[5] for r in mine))
        assert correct == sum(s == bool(r[5]) for s, r in zip(says, mine, strict=True))
        assert hits == sum(s and r[5] == 1 for s, r in zip(says, mine, strict=True))


def test_one_class_no_rows_and_separable(spark):
    rows = [(i, float(i), 1.0, 0.0, 0.0, int(i > 5)) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    table = as_table(df, FEATURES, "y", mask_of([F.col("id") <= 5, F.col("id") > 5, F.lit(False), F.lit(True)]), F.lit(15).cast("long"))
    low, high, none, cut = fit_many(table.select("mask", "y", "x0", "x1", "x2", "x3"), 4, [1.0, 1.0, 1.0, 100.0])
    assert (low.intercept, high.intercept, none.intercept) == (-math.inf, math.inf, 0.0)
    assert cut.converged and cut.coefficients[0] > 0
    judged = judge_many(table.select(F.col("test").alias("mask"), "y", "x0", "x1", "x2", "x3"), 4, [low, high, none, cut])
    assert [r[1] for r in judged] == [6, 6, 6, 12]
    with pytest.raises(Exception, match="missing"):
        as_table(df.withColumn("a", F.lit(None).cast("double")), FEATURES, "y", F.lit(1).cast("long"), F.lit(1).cast("long")).collect()


def test_learning_curve_by_single_fits(spark):
    rows = made_up(400, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {round(r.frac, 3): r for r in ML.learning_curve("logreg", df, FEATURES, "y", "id", {"C": 0.5}, cv=4, sizes=3).collect()}
    data = P.stratified_folds(df, "id", "y", 4, 42).withColumn("u", ML.unit_hash(F.col("id"), 42, "curve"))
    fold = {r.id: (r.fold, r.u) for r in data.collect()}
    for share in (0.1, 0.55, 1.0):
        seen, fresh = [], []
        for f in range(4):
            train = sorted((r for r in rows if fold[r[0]][0] != f), key=lambda r: fold[r[0]][1])
            train = train[:int(share * len(train))]
            w = single(train, 0.5)

            def accuracy(part, w=w):
                return np.mean([(np.dot(r[1:5], w[:4]) + w[4] > 0) == bool(r[5]) for r in part])
            seen.append(accuracy(train))
            fresh.append(accuracy([r for r in rows if fold[r[0]][0] == f]))
        r = got[round(share, 3)]
        assert (r.train_mean, r.train_std, r.val_mean, r.val_std) == pytest.approx(
            (np.mean(seen), np.std(seen), np.mean(fresh), np.std(fresh)), abs=1e-9)


def test_search_scores_are_those_of_single_fits(spark):
    rows = made_up(300, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    model, best, results = ML.random_search("logreg", df, FEATURES, "y", "id", n_iter=5, folds=3)
    fold = {r.id: r.fold for r in P.stratified_folds(df, "id", "y", 3, 42).collect()}
    for params, recall in results:
        want = []
        for f in range(3):
            w = single([r for r in rows if fold[r[0]] != f], params["C"])
            ones = [r for r in rows if fold[r[0]] == f and r[5] == 1]
            want.append(np.mean([np.dot(r[1:5], w[:4]) + w[4] > 0 for r in ones]))
        assert recall == pytest.approx(np.mean(want), abs=1e-9)
    assert best == max(results, key=lambda r: r[1])[0]
    assert ML.predict(model, df, FEATURES).count() == 300


def test_cuts_are_ranks(spark):
    """Where a rank ends is found without ranking; between rows of one key it is not."""
    from vitalis.functions.ranking import hash_rank, rank_cuts

    df = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("id"), (F.col("id") % 3).alias("g"))
    df = df.withColumn("u", ML.unit_hash(F.when(F.col("id") != "k7", F.col("id")), 42, "x")).withColumn(
        "id", F.when(F.col("id") != "k7", F.col("id")))
    sets = [F.col("g") == 0, F.col("g") != 1]
    sizes, cuts = rank_cuts(df, sets, "u", "id", lambda n: [[0, 1, 500, n[0]], [3, 1999, n[1] + 5]])
    assert sizes == [1000, 2000]
    for s, of in zip(sets, cuts, strict=True):
        ranked = hash_rank(df.where(s), [], "u", "r", tie="id")
        for cut in of:
            want = {r.id for r in ranked.where(F.col("r") <= cut.rank).collect()}
            assert {r.id for r in df.where(s & cut.holds(F.col("u"), F.col("id"))).collect()} == want
    twice = df.unionByName(df)
    assert rank_cuts(twice, sets[:1], "u", "id", lambda n: [[501]])[1] is None
    assert rank_cuts(twice, sets[:1], "u", "id", lambda n: [[502]])[1] is not None


def test_split_and_curve_do_not_rank(spark, monkeypatch):
    """Halves and sizes come from comparing rows with a cut; rows of one key are still parted by rank."""
    import vitalis.operators.prep as P

    used = []
    keep = P.hash_rank
    monkeypatch.setattr(P, "hash_rank", lambda *a, **k: used.append(a[1]) or keep(*a, **k))
    df = spark.range(1000).select(F.concat(F.lit("k"), F.col("id")).alias("id"), F.col("id").cast("double").alias("x.y"),
                                  (F.col("id") % 4 == 0).cast("int").alias("y"))
    train, test = P.stratified_split(df, "id", "y", 0.25)
    assert not used
    assert {r.y: r["count"] for r in test.groupBy("y").count().collect()} == {0: 188, 1: 63}
    assert train.count() == 749 and sorted(train.columns) == ["id", "x.y", "y"]
    ranked = keep(P._with_fraction(df, "id", "y", 0.25, 42), ["y"], P.U, "r", tie="id")
    want = {r.id for r in ranked.where("r <= CASE y WHEN 0 THEN 188 ELSE 63 END").collect()}
    assert {r.id for r in test.collect()} == want
    twice = df.withColumn("id", F.lit("same"))
    assert P.split_flags(twice, "id", "y", 0.25).where("is_test").count() == 251 and used
    used.clear()
    curve = ML.learning_curve("logreg", df, ["x.y"], "y", "id", cv=3, sizes=3)
    assert len(used) == 1 and curve.count() == 3  # the folds, nothing else


def test_shuffles_are_dropped(spark):
    from vitalis.session import CLEANUP, materialised

    before = spark.conf.get(CLEANUP)
    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    had = tracker.shuffleStatuses().size()
    kept = materialised(spark.range(5000).repartition(3).groupBy((F.col("id") % 7).alias("g")).count(), "t")
    assert tracker.shuffleStatuses().size() <= had and spark.conf.get(CLEANUP) == before
    assert kept.count() == 7
