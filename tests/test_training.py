"""The composed training run, and promotions by several writers."""

import random
import threading

import pytest

from vitalis.operators import evaluate as V
from vitalis.operators import models as ML
from vitalis.operators import prep as P
from vitalis.operators import rebalance as R
from vitalis.operators import registry as G
from vitalis.operators import score as S
from vitalis.operators.training import RunConfig, train_run
from vitalis.sources import packages
from vitalis.sources.packages import (
    Package, PromotionConflict, active_info, load_package, promote, promotion_log, promotion_version,
    register_package, registered, save_package,
)


def labelled(spark, n=400):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(5, 2)
        rows.append((f"r{i}", a, b, int(a + 0.2 * b + rng.gauss(0, 0.5) > 2.2)))
    return spark.createDataFrame(rows, "id string, a double, `b.x` double, y int")


FEATURES = ["a", "b.x"]


def test_run_is_its_operators_in_order(spark, tmp_path):
    df = labelled(spark)
    run = train_run(df, RunConfig("logreg", FEATURES, "y", "id", name="logistic (smote)", sampler="smote", params={"C": 2.0}))
    train, test = P.stratified_split(df, "id", "y", 0.2, 42)
    made = R.smote(train, "id", FEATURES, "y", seed=42)
    scaler = P.scaler_dict(P.fit_scaler(made, FEATURES))
    model = ML.fit("logreg", P.apply_scaler(made, scaler), FEATURES, "y", {"C": 2.0}, key="id")
    scored = ML.predict(model, P.apply_scaler(test, scaler).withColumnRenamed("y", "label"), FEATURES, "id")
    row, met = run.history.first(), V.metrics(scored).first()
    for m in G.METRICS[:-1]:
        assert row[m] == pytest.approx(met[m]) == pytest.approx(run.package.metrics[m])
    assert row["auc"] == pytest.approx(V.auc(scored).first()["auc"])
    assert run.counts == {"train": train.count(), "train_rebalanced": made.count(), "test": test.count()}
    by_class = {r["y"]: r["count"] for r in made.groupBy("y").count().collect()}
    assert by_class[0] == by_class[1]
    assert set(run.package.importance) == set(FEATURES)
    assert {f: pytest.approx(v) for f, v in run.package.scaler.items()} == scaler
    back = load_package(spark, save_package(run.package, str(tmp_path / "p")))
    first = {r.id: r.prob for r in S.score(df, back, "id").collect()}
    again = {r.id: r.prob for r in ML.predict(model, P.apply_scaler(df, scaler), FEATURES, "id").collect()}
    assert first == pytest.approx(again, abs=1e-9)
    merged = G.upsert_run(run.history, run.history)
    assert [r["model"] for r in merged.collect()] == ["logistic"]


@pytest.mark.parametrize("kind", ["logreg", "knn"])
def test_run_with_a_search(spark, kind):
    run = train_run(labelled(spark, 200), RunConfig(kind, FEATURES, "y", "id", candidates=3))
    assert run.package.params in ML.sample_grid(ML.SEARCH_SPACES[kind], 3)
    assert 0.5 < run.package.metrics["auc"] <= 1.0 and run.counts["train"] == run.counts["train_rebalanced"]


def test_run_names_what_is_wrong(spark):
    df = labelled(spark, 60)
    with pytest.raises(ValueError, match="no columns"):
        train_run(df, RunConfig("logreg", ["a", "nope"], "y", "id"))
    with pytest.raises(ValueError, match="model_type"):
        train_run(df, RunConfig("oracle", FEATURES, "y", "id"))
    with pytest.raises(Exception, match="impute or fill"):
        train_run(df.selectExpr("id", "nullif(a, a) AS a", "`b.x`", "y"), RunConfig("logreg", FEATURES, "y", "id"))


def linear(spark):
    return Package(model_type="linear", model=None, features=["a"], target="y", scaler={"a": (0.0, 1.0)},
                   linear={"intercept": 0.0, "coefficients": {"a": 1.0}}, metrics={"f2": 0.5})


def test_two_promoters_cannot_both_win(spark, tmp_path):
    registry, df = str(tmp_path / "registry"), labelled(spark, 40)
    register_package(spark, registry, linear(spark), "waiting", str(tmp_path / "p"))
    assert promotion_version(spark, registry) == 0 and active_info(spark, registry).isEmpty()
    won, lost, start = [], [], threading.Barrier(4)

    def work(name):
        start.wait()
        try:
            promote(spark, registry, linear(spark), name, str(tmp_path / "p"), df, expected=0)
            won.append(name)
        except PromotionConflict:
            lost.append(name)

    threads = [threading.Thread(target=work, args=(f"w{k}",)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 3
    assert {r["package"] for r in registered(spark, registry).collect()} == {"waiting", *won, *lost}
    assert [tuple(r) for r in promotion_log(spark, registry).select("package", "version").collect()] == [(won[0], 1)]
    promote(spark, registry, linear(spark), "next", str(tmp_path / "p"), df)
    with pytest.raises(PromotionConflict):
        promote(spark, registry, linear(spark), "late", str(tmp_path / "p"), df, expected=1)
    row = active_info(spark, registry).first()
    assert (row["package"], row["version"]) == ("next", 2) and row["medians"]["a"] is not None


def test_a_claim_without_a_row_is_passed_over(spark, tmp_path):
    """A promoter that dies between claim and row leaves the version before active; the next one goes on."""
    registry, df = str(tmp_path / "registry"), labelled(spark, 40)
    promote(spark, registry, linear(spark), "one", str(tmp_path / "p"), df)
    assert packages._claim(spark, registry, 2)
    assert active_info(spark, registry).first()["package"] == "one"
    promote(spark, registry, linear(spark), "three", str(tmp_path / "p"), df)
    assert active_info(spark, registry).first()["version"] == 3
