"""Hand-worked cases (a few rows each) and properties of the operators."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalis.functions.ranking import exact_quantiles
from vitalis.functions.stats import student_t_two_sided
from vitalis.operators import clean as C
from vitalis.operators import evaluate as V
from vitalis.operators import explain as X
from vitalis.operators import missing as M
from vitalis.operators import models as ML
from vitalis.operators import prep as P
from vitalis.operators import rebalance as R
from vitalis.operators import registry as G
from vitalis.operators import score as S
from vitalis.operators.neighbours import knn_join
from vitalis.sources.packages import Package, load_package, save_package
from vitalis.sources.tables import MissingColumnsError, require_columns, write_clean_csv


# --- cleaning --------------------------------------------------------------------
def test_numeric_acceptance_edge(spark):
    # 1 of 10 parseable -> 0.9 null share -> stays text; 2 of 10 -> 0.8 -> numeric
    rows = [(str(i) if i < 1 else "x", str(i) if i < 2 else "x") for i in range(10)]
    df = spark.createDataFrame(rows, "a string, b string")
    out = C.coerce_numeric(df)
    types = dict(out.dtypes)
    assert types["a"] == "string" and types["b"] == "double"


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    filled = C.fill_mode(df, ["c"])
    assert sorted(r[0] for r in filled.collect()) == ["a", "a", "a", "b", "b"]


def test_codebook_sorted_and_unseen_label(spark):
    df = spark.createDataFrame([("z",), ("a",), ("m",)], "c string")
    book = C.fit_codebook(df, ["c"])
    assert {(r.label, r.code) for r in book.collect()} == {("a", 0), ("m", 1), ("z", 2)}
    new = spark.createDataFrame([(1, "m"), (2, "q"), (3, " 7 ")], "k int, c string")
    enc = S.encode_for_scoring(new, ["c"], book).orderBy("k").collect()
    assert [r.c for r in enc] == [1.0, None, None]


def test_add_difference_needs_both(spark):
    df = spark.createDataFrame([("120", 80.0)], "`SBP value` string, other double")
    assert C.add_difference(df).columns == df.columns
    df2 = spark.createDataFrame([("120", 80.0)], "`Systolic` string, `dbp` double")
    assert C.add_difference(df2).first()["Pulse_Pressure"] == 40.0


def test_guard_features():
    cols = ["AGE", "Outcome_flag", "EF", "death_date", "BNP"]
    assert C.guard_features(["EF", "Outcome_flag", "missing", "BNP", "death_date"], cols) == ["EF", "BNP"]


def test_resolve_target_and_features():
    assert C.resolve_target(["x", "ACS", "HEART FAILURE"]) == "HEART FAILURE"
    assert C.resolve_target(["x", "y"]) == "x"
    assert C.resolve_features(["EF", "x", "t"], "t") == ["EF"]
    assert C.resolve_features(["a", "b", "t"], "t") == ["a", "b"]


# --- ranks / quantiles --------------------------------------------------------------
def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.integers(0, 20, 300).astype(float), rng.normal(size=200)])
    df = spark.createDataFrame([(float(v), i % 3) for i, v in enumerate(vals)], "value double, g int")
    q = {r.g: (r.q_0, r.q_1, r.q_2) for r in exact_quantiles(df, ["g"], "value", [0.1, 0.5, 0.9]).collect()}
    for g in range(3):
        sub = vals[[i for i in range(len(vals)) if i % 3 == g]]
        np.testing.assert_allclose(q[g], np.percentile(sub, [10, 50, 90]), rtol=1e-12)


def test_t_pvalue_known_values():
    p = student_t_two_sided(np.array([2.228138852, 0.0, 1.0]), np.array([10.0, 5.0, 1.0]))
    np.testing.assert_allclose(p, [0.05, 1.0, 0.5], atol=1e-6)


# --- neighbours / imputation / sampling ------------------------------------------------
def _brute(q, p, k, self_exclude):
    out = {}
    for i, (qk, qx) in enumerate(q):
        d = [(float(np.sum((qx - px) ** 2)), pk) for pk, px in p if not (self_exclude and pk == qk)]
        out[qk] = [pk for _, pk in sorted(d)[:k]]
    return out


def test_knn_join_matches_brute_force_with_duplicates(spark):
    rng = np.random.default_rng(7)
    pts = np.round(rng.normal(size=(300, 3)) * 3)  # many exact duplicates
    rows = [(i, *map(float, x)) for i, x in enumerate(pts)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = knn_join(df, df, qkey="id", pkey="id", features=["a", "b", "c"], k=4, exclude_self=True,
                   target_per_cell=8).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r.query_key, r.rank)):
        res.setdefault(r.query_key, []).append(r.point_key)
    exp = _brute([(i, x) for i, x in enumerate(pts)], [(i, x) for i, x in enumerate(pts)], 4, True)
    assert res == exp


def test_knn_impute_hand_case(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0), (3, 10.0, 10.0), (4, 1.5, None)],
                               "id int, a double, b double")
    out = {r.id: r.b for r in M.knn_impute(df, "id", ["a", "b"], k=2).collect()}
    assert out[4] == pytest.approx(1.5)  # mean of rows 1 and 2 (nearest on a)


def test_smote_balances_and_interpolates(spark):
    rows = [(i, float(i), float(i % 7), 1 if i < 12 else 0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, y double, lab int")
    out = R.smote(df, "id", ["x", "y"], "lab", k=3)
    counts = {r.lab: r["count"] for r in out.groupBy("lab").count().collect()}
    assert counts[0] == counts[1] == 48
    synth = out.where(F.col("id").contains("#")).collect()
    assert len(synth) == 36
    assert all(0.0 <= r.x <= 11.0 for r in synth)


def test_stratified_split_exact_shares(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    flags = P.split_flags(df, "id", "y", 0.2)
    got = {(r.y, r.is_test): r["count"] for r in flags.groupBy("y", "is_test").count().collect()}
    assert got[(1, True)] == 50 and got[(0, True)] == 150


def test_scaler_population_std_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    sc = P.scaler_dict(P.fit_scaler(df, ["a", "b"]))
    assert sc["a"] == (2.0, 1.0) and sc["b"] == (5.0, 1.0)


# --- evaluation ------------------------------------------------------------------------
@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    p = np.clip(0.3 * y + rng.random(400) * 0.7, 0, 1).round(2)
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))],
                                 "key long, label double, prob double")


def test_threshold_at_half_equals_confusion(spark, scored):
    tm = V.threshold_metrics(scored).where(F.col("threshold") == 0.5).first()
    cm = {(r.actual, r.predicted): r["count"] for r in V.confusion(scored, 0.5).collect()}
    assert (tm.tp, tm.fp, tm.fn, tm.tn) == (cm[(1, 1)], cm[(0, 1)], cm[(1, 0)], cm[(0, 0)])


def test_roc_monotone_and_trapezoid_equals_auc(spark, scored):
    pts = sorted((r.fpr, r.tpr) for r in V.roc_curve(scored).collect())
    assert pts[0] == (0.0, 0.0) and pts[-1] == (1.0, 1.0)
    area = sum((x1 - x0) * (y0 + y1) / 2 for (x0, y0), (x1, y1) in zip(pts, pts[1:]))
    assert area == pytest.approx(V.auc(scored).first().auc, abs=1e-12)


def test_auc_single_class_is_zero(spark):
    df = spark.createDataFrame([(1.0, 0.2), (1.0, 0.9)], "label double, prob double")
    assert V.auc(df).first().auc == 0.0


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0.1, 1.0), (0.3, 0.0), (0.0, 0.0), (1.0, 1.0)], "prob double, label double")
    bins = {r.bin: r.n for r in V.calibration(df).collect()}
    assert bins == {0: 2, 2: 1, 9: 1}


def test_decision_curve_without_positives(spark):
    df = spark.createDataFrame([(0.0, 0.9), (0.0, 0.1)], "label double, prob double")
    rows = V.decision_curve(df).collect()
    assert len(rows) == 100
    assert all(r.net_benefit <= 0 for r in rows)


# --- registry ------------------------------------------------------------------------------
def test_leaderboard_weights_not_100_falls_back_to_f2(spark):
    import datetime as dt
    h = spark.createDataFrame([("r1", "a", 0.9, 0.1, 0.9, 0.5, 0.2, 0.5, 3, None, dt.datetime(2024, 1, 1)),
                               ("r2", "b", 0.1, 0.9, 0.1, 0.5, 0.8, 0.5, 3, None, dt.datetime(2024, 1, 2))],
                              G.HISTORY_SCHEMA)
    top = G.leaderboard(h, {"recall": 10, "precision": 10, "f1": 10, "accuracy": 10}).where("rank = 1").first()
    assert top.model == "b"
    top = G.leaderboard(h, {"recall": 0, "precision": 0, "f1": 0, "accuracy": 100}).where("rank = 1").first()
    assert top.model == "a"


# --- scoring --------------------------------------------------------------------------------
def test_verdict_boundaries(spark):
    df = spark.createDataFrame([(0.5,), (0.8,), (0.8001,), (0.125,)], "prob double")
    out = S.verdict(df.withColumn("risk_pct", F.bround(F.col("prob") * 100, 2))).collect()
    assert [(r.verdict, r.action) for r in out] == [
        ("negative", "maintain"), ("positive", "monitor"), ("positive", "urgent"), ("negative", "maintain")]
    assert out[3].risk_pct == 12.5


def test_compare_to_typical_edges(spark):
    df = spark.createDataFrame([(1, 110.0, 5.0, 2.0)], "k int, a double, b double, c double")
    rows = {r.feature: r for r in S.compare_to_typical(df, "k", {"a": 3, "b": 2, "c": 1},
                                                       {"a": 100.0, "b": 0.0, "c": 1.0}).collect()}
    assert rows["a"].assessment == "normal"          # exactly 10 %
    assert rows["b"].assessment == "N/A"             # median 0
    assert rows["c"].assessment == "high (100%)"


def test_missing_columns_before_fill(spark):
    df = spark.createDataFrame([(1, None, 2.0)], "k int, a double, b double")
    assert df.select(S.missing_columns(["a", "b"]).alias("m")).first().m == ["a"]


def test_require_columns_and_clean_sink_gate(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a int, b double")
    with pytest.raises(MissingColumnsError):
        require_columns(df, ["a", "zz"])
    with pytest.raises(ValueError):
        write_clean_csv(df, str(tmp_path / "x"))


def test_shapley_sums_to_prob_minus_base(spark):
    feats = ["a", "b", "c"]
    lin = {"intercept": 0.1, "coefficients": {"a": 1.0, "b": -2.0, "c": 0.5}}
    sc = {f: (0.0, 1.0) for f in feats}
    df = spark.createDataFrame([(1, 1.0, 0.5, -1.0), (2, -0.3, 0.0, 2.0)], "k int, a double, b double, c double")
    med = {"a": 0.2, "b": 0.1, "c": 0.0}
    fn = X.linear_prob_fn(feats, sc, lin)
    probs = {r.k: r.prob for r in fn(df).collect()}
    for exact in (True, False):
        phi = X.shapley(df, "k", feats, med, fn, method="exact" if exact else "sampled", n_perm=16)
        for r in phi.groupBy("k").agg(F.sum("contribution").alias("s"), F.first("base").alias("b")).collect():
            assert r.s == pytest.approx(probs[r.k] - r.b, abs=1e-9)


# --- models: planted signal -------------------------------------------------------------
@pytest.fixture(scope="module")
def planted(spark):
    df = spark.range(3000).select(
        F.col("id"),
        (F.rand(1) * 2 - 1).alias("x1"), (F.rand(2) * 2 - 1).alias("x2"), (F.rand(3) * 2 - 1).alias("x3"),
        F.lit(1.0).alias("const"))
    df = df.withColumn("y", (F.col("x1") + 0.5 * F.col("x2") > 0).cast("int")).cache()
    train, test = P.stratified_split(df, "id", "y", 0.25)
    return train.cache(), test.withColumnRenamed("y", "label").cache()


@pytest.mark.parametrize("mt,params", [
    ("logreg", {"C": 10.0}), ("forest", {"trees": 20, "depth": 6}), ("boost", {"trees": 20, "depth": 3}),
    ("svm", {"kernel": "linear", "C": 10.0}), ("svm", {"kernel": "rbf", "C": 10.0, "n_components": 100}),
    ("knn", {"k": 7}),
])
def test_planted_signal(spark, planted, mt, params):
    train, test = planted
    feats = ["x1", "x2", "x3"]
    m = ML.fit(mt, train, feats, "y", params, key="id")
    auc = V.auc(ML.predict(m, test, feats, key="id")).first().auc
    assert auc > 0.9


def test_permutation_importance_constant_feature_is_zero(spark, planted):
    train, test = planted
    feats = ["x1", "x2", "const"]
    m = ML.fit("logreg", train, feats, "y", {"C": 10.0})
    imp = {r.feature: r.importance for r in ML.permutation_importance(m, test, feats, "label", "id").collect()}
    assert abs(imp["const"]) < 1e-12 and imp["x1"] > 0.1


def test_package_roundtrip(spark, planted, tmp_path):
    train, test = planted
    feats = ["x1", "x2", "x3"]
    m = ML.fit("forest", train, feats, "y", {"trees": 5, "depth": 4})
    pkg = Package("forest", m, feats, "y", scaler={f: (0.0, 1.0) for f in feats}, medians={f: 0.0 for f in feats})
    back = load_package(spark, save_package(pkg, str(tmp_path / "pkg")))
    a = {r.id: r.prob for r in S.score(test, pkg, "id").collect()}
    b = {r.id: r.prob for r in S.score(test, back, "id").collect()}
    assert a == b and len(a) == test.count()
    assert math.isclose(sum(a.values()) / len(a), sum(b.values()) / len(b))


def test_udf_runs_without_installed_package(tmp_path):
    # Executors have no copy of the package: the pandas UDF must travel with
    # the task. A fresh driver started outside the repository checks that.
    import subprocess
    import sys as _sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from vitalis.session import get_spark\n"
        "from pyspark.sql import functions as F\n"
        "from vitalis.functions.stats import t_pvalue\n"
        "s = get_spark('udf-ship', 2)\n"
        "r = s.range(1).select(t_pvalue(F.lit(2.0), F.lit(10.0)).alias('p')).collect()\n"
        "print(round(r[0].p, 4))\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([_sys.executable, "-c", code], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert out.stdout.strip().splitlines()[-1] == "0.0734"


def test_materialised_split_matches_lazy_split(spark):
    # the written split is the same split: halves disjoint, complete, and equal
    # to the lazily computed halves; per-class test counts are round(0.2 * n)
    df = spark.range(503).select(F.col("id"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    tr_m, te_m = P.stratified_split(df, "id", "y", 0.2, materialize=True)
    tr_l, te_l = P.stratified_split(df, "id", "y", 0.2, materialize=False)
    ids = lambda d: sorted(r.id for r in d.select("id").collect())
    assert ids(tr_m) == ids(tr_l) and ids(te_m) == ids(te_l)
    assert not set(ids(tr_m)) & set(ids(te_m))
    assert len(ids(tr_m)) + len(ids(te_m)) == 503
    per = {r.y: r["count"] for r in te_m.groupBy("y").count().collect()}
    n1 = 503 // 4 + 1
    assert per[1] == int(math.floor(0.2 * n1 + 0.5)) and per[0] == int(math.floor(0.2 * (503 - n1) + 0.5))
