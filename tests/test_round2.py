"""Cases found wrong in review: ties on cell borders, NULL groups, caps, candidate lists, NULL labels."""

import random

import pytest
from pyspark.sql import functions as F

from vitalis.functions import ranking as R
from vitalis.operators import clean as C
from vitalis.operators import explain as X
from vitalis.operators import explore as E
from vitalis.operators import models as ML
from vitalis.operators import prep as P
from vitalis.operators import score as S
from vitalis.operators.neighbours import knn_join
from vitalis.sources.packages import Package, active_info, load_package, promote, register_package, save_package


def nearest(points, q, k):
    return sorted((sum((a - b) ** 2 for a, b in zip(p[1:], q[1:], strict=True)), p[0]) for p in points)[:k]


@pytest.mark.parametrize("width,k", [(20, 9), (4, 30)])
def test_knn_border_ties_and_low_cardinality(spark, width, k):
    rng = random.Random(width)
    points = [(1000 - i, float(rng.randrange(width)), float(rng.randrange(width))) for i in range(400)]
    queries = [(i, float(rng.randrange(width)), float(rng.randrange(width))) for i in range(60)]
    got = {}
    for r in knn_join(spark.createDataFrame(queries, "id long, x double, y double"),
                      spark.createDataFrame(points, "pid long, x double, y double"), qkey="id", pkey="pid",
                      features=["x", "y"], k=k, target_per_cell=4).collect():
        got.setdefault(r.query_key, []).append((r.d2, r.point_key))
    for q in queries:
        assert sorted(got[q[0]]) == nearest(points, q, k)


def test_knn_outlying_queries_are_answered(spark):
    points = [(i, float(i), 0.0) for i in range(3000)]
    queries = [(1, -1e9, 0.0), (2, 1e9, 0.0), (3, 1500.2, 0.0)]
    got = knn_join(spark.createDataFrame(queries, "id long, x double, y double"),
                   spark.createDataFrame(points, "pid long, x double, y double"), qkey="id", pkey="pid",
                   features=["x", "y"], k=5, target_per_cell=2).collect()
    assert {q: sorted(r.point_key for r in got if r.query_key == q) for q in (1, 2, 3)} == {
        1: [0, 1, 2, 3, 4], 2: [2995, 2996, 2997, 2998, 2999], 3: [1498, 1499, 1500, 1501, 1502]}


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "a", float(i)) for i in range(30)], "k long, g string, v double")
    q = {r.g: r.q_0 for r in R.exact_quantiles(df, ["g"], "v", [0.5]).collect()}
    assert q == {None: 13.5, "a": 15.0}
    assert {r.grp if "grp" in r else r[0] for r in E.box_stats(df, "v", "g").collect()} >= {None, "a"}
    with pytest.raises(Exception, match="holds NULL"):
        P.split_flags(df, "k", "g").collect()


def test_scatter_keeps_every_row(spark):
    df = spark.range(6000).select(F.col("id"), F.col("id").cast("double").alias("v"), F.lit("g").alias("g"))
    assert E.scatter3d_points(df, "id", "v", "v", "v", "g").count() == 6000
    assert E.scatter3d_points(df, "id", "v", "v", "v", "g", max_points=10).count() == 10


def test_significance_uses_the_unrounded_p(spark):
    rows = [("a" if i % 2 else "b", float(i % 7) + (0.4 if i % 2 else 0.0)) for i in range(200)]
    r = E.t_tests(spark.createDataFrame(rows, "t string, v double"), "t", ["v"]).first()
    edge = E.t_tests(spark.createDataFrame(rows, "t string, v double"), "t", ["v"], alpha=r.p).first()
    assert edge.p == round(edge.p, 5)


def test_candidate_lists_are_complete():
    assert ML.SEARCH_SPACES["knn"]["k"] == list(range(3, 20))
    assert ML.SEARCH_SPACES["forest"]["trees"] == ML.SEARCH_SPACES["boost"]["trees"] == [50, 100, 200, 300]
    assert ML.SEARCH_SPACES["boost"]["subsample"] == [0.6, 0.8, 1.0]
    assert ML.SEARCH_SPACES["boost"]["depth"] == [3, 5, 7, 10]


def labelled(spark, n=240):
    rng = random.Random(4)
    rows = [(i, i % 2, rng.gauss(1.5 * (i % 2), 1.0), rng.gauss(0, 1)) for i in range(n)]
    return spark.createDataFrame(rows, "k long, y int, a double, b double")


def test_search_with_five_folds(spark):
    model, best, results = ML.random_search("logreg", labelled(spark), ["a", "b"], "y", "k", n_iter=3, folds=5)
    assert len(results) == 3 and best in [c for c, _ in results]
    assert ML.recall_of_class1(ML.predict(model, ML._prepare(labelled(spark), ["a", "b"], "y"), ["a", "b"], "k")) > 0.6


def test_null_label_is_the_same_in_training_and_scoring(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "a")], "k long, c string")
    book = C.fit_codebook(df, ["c"], null_label=C.NULL_LABEL)
    there = {r.k: r.c for r in C.encode(df, book, C.NULL_LABEL).collect()}
    again = {r.k: r.c for r in S.encode_for_scoring(df, ["c"], book, C.NULL_LABEL).collect()}
    assert there == again and None not in there.values()
    assert {r.k: r.c for r in S.encode_for_scoring(df, ["c"], book).collect()}[2] is None


def test_codebook_ranks_of_many_labels(spark):
    labels = [f"v{i:04d}" for i in range(3000)]
    df = spark.createDataFrame([(x, x[::-1]) for x in labels], "a string, b string").repartition(7)
    got = {(r["column"], r.label): r.code for r in C.fit_codebook(df).collect()}
    assert got == {("a", x): i for i, x in enumerate(sorted(labels))} | {
        ("b", x): i for i, x in enumerate(sorted(y[::-1] for y in labels))}


def test_shapley_method_is_explicit(spark):
    df = labelled(spark, 4)
    fn = X.linear_prob_fn(["a", "b"], {}, {"intercept": 0.1, "coefficients": {"a": 1.0, "b": -1.0}})
    with pytest.raises(ValueError):
        X.shapley(df, "k", ["a", "b"], {}, fn, method="auto")


def test_packages_are_versioned_and_promotion_is_found(spark, tmp_path):
    linear = {"intercept": 0.0, "coefficients": {"a": 1.0, "b": 0.0}}
    book = spark.createDataFrame([("c", "x", 0)], "column string, label string, code int")
    pkg = Package(model_type="linear", model=None, features=["a", "b"], target="y", linear=linear, codebook=book)
    one = save_package(pkg, str(tmp_path / "p"))
    pkg.codebook = None
    two = save_package(pkg, str(tmp_path / "p"))
    assert one != two
    assert load_package(spark, one).codebook.count() == 1 and load_package(spark, two).codebook is None
    registry = str(tmp_path / "registry")
    register_package(spark, registry, pkg, "first", str(tmp_path / "p"))
    assert active_info(spark, registry).isEmpty()
    promoted = promote(spark, registry, pkg, "second", str(tmp_path / "p"), labelled(spark))
    row = active_info(spark, registry).first()
    assert row["package"] == "second" and set(promoted.medians) == {"a", "b"}
    back = load_package(spark, row["path"])
    scored = S.score(labelled(spark), back, "k")
    assert scored.count() == 240 and scored.where("prob is null").isEmpty()


def test_package_roundtrip_scores_unlabelled_documents_too(spark):
    from __spark_entry__ import SMOKE_DIR, queries

    ids = [r.doc_id for r in spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").select("doc_id").collect()]
    labelled = spark.read.parquet(f"{SMOKE_DIR}/labels.parquet").select("doc_id").distinct().count()
    got = queries()["package_roundtrip"](spark, SMOKE_DIR).collect()
    assert labelled < len(ids) and sorted(r.doc_id for r in got) == sorted(ids)
    assert all(0 <= r.prob <= 1 for r in got)


@pytest.mark.parametrize("query", ["permutation_importance", "intrinsic_importance", "model_svm_rbf"])
def test_queries_fit_the_operators_defaults(query, monkeypatch):
    from vitalis.plans import queries_models as Q
    from vitalis.plans.catalog import QUERIES

    seen = []

    def fit(kind, train, features, label, params=None, **kw):
        seen.append(params or {})
        raise StopIteration

    monkeypatch.setattr(Q, "_order_split", lambda spark, sf: (None, None))
    monkeypatch.setattr(ML, "fit", fit)
    with pytest.raises(StopIteration):
        QUERIES[query](None, None)
    assert len(seen) == 1 and not {"trees", "depth", "n_components"} & set(seen[0])


def test_clinical_names_reach_the_models(spark):
    names = {"a": "D.O.A", "b": "TYPE OF ADMISSION-EMERGENCY/OPD"}
    df = labelled(spark)
    for old, new in names.items():
        df = df.withColumnRenamed(old, new)
    feats = list(names.values())
    for kind, params in (("logreg", {}), ("forest", {"trees": 5, "depth": 3}), ("svm", {"kernel": "linear"}),
                         ("knn", {"k": 3})):
        model = ML.fit(kind, df, feats, "y", params, key="k")
        scored = ML.predict(model, df, feats, "k")
        assert scored.count() == 240 and set(feats) <= set(scored.columns)
    ct = E.crosstab_pct(df.withColumn("x.y", F.col("k") % 3 * 1e10), "y", "x.y")
    assert ct.columns == ["y", "0.0", "1.0E10", "2.0E10"] and ct.count() == 2
