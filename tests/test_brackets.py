"""Exact quantiles from rank brackets, and the operators on them, against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalis.functions import brackets
from vitalis.functions.brackets import bracket_quantiles
from vitalis.operators import explore as E
from vitalis.operators import missing as M

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def made_up(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = rng.choice(["a", "a", "a", "b", None])
        x = rng.choice([None, float("nan"), rng.gauss(0, 1), 5.0, 5.0, -1.0, rng.expovariate(1)])
        rows.append((i, g, x, rng.randrange(4), rng.random() if g == "b" else 7.0))
    return rows


def expect(rows, by):
    out = {}
    for at, name in ((2, "x"), (3, "y.z"), (4, "w")):
        groups = {}
        for r in rows:
            groups.setdefault(r[1] if by else None, []).append(r[at])
        for g, values in groups.items():
            v = np.array([x for x in values if x is not None and x == x], float)
            out[g, name] = (len(v), *(np.quantile(v, PROBS) if len(v) else [None] * len(PROBS)))
    return out


def same(df, want, by):
    got = {(r["g"] if by else None, r["column"]): (r["n"], *(r[f"q_{j}"] for j in range(len(PROBS)))) for r in df.collect()}
    assert set(got) == set(want)
    for key, values in want.items():
        assert got[key] == pytest.approx(values, rel=1e-12, abs=1e-12), key


@pytest.mark.parametrize("accuracy, most_inside", [(10_000, 4096), (50, 40), (10, 3), (100, 0)])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles(spark, accuracy, most_inside, by):
    """Coarse sketches and brackets that may hold almost nothing: narrowed and, where wrong, opened again; still exact."""
    rows = made_up(1500)
    df = spark.createDataFrame(rows, "id long, g string, x double, `y.z` int, w double").repartition(5)
    if most_inside == 0:
        most_inside = 1
    same(bracket_quantiles(df, by, ["x", "y.z", "w"], PROBS, accuracy, most_inside), expect(rows, by), by)


def test_many_groups_by_ranks(spark, monkeypatch):
    rows = made_up(800, 3)
    df = spark.createDataFrame(rows, "id long, g string, x double, `y.z` int, w double")
    monkeypatch.setattr(brackets, "MOST_GROUPS", 2)
    same(bracket_quantiles(df, ["g"], ["x", "y.z", "w"], PROBS), expect(rows, ["g"]), ["g"])


def test_empty_and_missing(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert [tuple(r) for r in bracket_quantiles(df, [], ["x"], [0.5]).collect()] == [("x", 0, None, None, None)]
    assert bracket_quantiles(df, ["g"], ["x"], [0.5]).collect() == []
    none = spark.createDataFrame([("a", None), ("b", 2.0)], "g string, x double")
    assert {tuple(r) for r in bracket_quantiles(none, ["g"], ["x"], [0.5]).collect()} == {
        ("a", "x", 0, None, None, None), ("b", "x", 1, 2.0, 2.0, 2.0)}
    assert M.feature_medians(none.where("x is null"), ["x"]).collect() == []


def test_describe_and_box_of_a_null_group(spark):
    rows = made_up(900, 8)
    df = spark.createDataFrame(rows, "id long, g string, x double, y int, w double")
    d = {r["column"]: r for r in E.describe_table(df, ["x", "y", "w"]).collect()}
    for at, name in ((2, "x"), (3, "y"), (4, "w")):
        v = np.array([r[at] for r in rows if r[at] is not None and r[at] == r[at]], float)
        r = d[name]
        assert (r["count"], r["min"], r["max"]) == (len(v), v.min(), v.max())
        assert (r["mean"], r["std"], r["p25"], r["p50"], r["p75"]) == pytest.approx(
            (v.mean(), v.std(ddof=1), *np.quantile(v, [0.25, 0.5, 0.75])))
    for r in E.box_stats(df, "x", "g").collect():
        v = np.array([x[2] for x in rows if x[1] == r["grp"] and x[2] is not None and x[2] == x[2]])
        q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert (r["n"], r["n_outliers"]) == (len(v), len(v) - len(inside))
        assert (r["q1"], r["median"], r["q3"], r["whisker_low"], r["whisker_high"]) == pytest.approx((q1, q2, q3, inside.min(), inside.max()))


def test_no_long_form_and_no_table_between(spark):
    """The plan of the second pass reads the rows once, without a row expansion."""
    df = spark.range(10_000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).alias("y"))
    seen = []
    made = brackets._pass

    def look(*args):
        out = made(*args)
        seen.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out
    brackets._pass = look
    try:
        assert {r["column"]: r["q_0"] for r in bracket_quantiles(df, [], ["x", "y"], [0.5]).collect()} == {"x": 4999.5, "y": 3.0}
    finally:
        brackets._pass = made
    assert len(seen) == 1 and "Generate" not in seen[0] and "Expand" not in seen[0] and seen[0].count("Range (") == 1
