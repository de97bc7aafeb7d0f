"""Queries for models (F1-F9). Fitted models cannot be reproduced in SQL, so
these are rows/property checked, except the k-NN classifier whose
probabilities are exact and have an oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalis.functions.rng import PRIME, round_keys
from vitalis.operators import evaluate as V
from vitalis.operators import models as ML
from vitalis.operators import prep as P
from vitalis.plans.catalog import register, rounded, with_ctes
from vitalis.plans.fixtures import (
    DOC_FEATURES, DOC_LABELS_SQL, ORDER_FEATURES, ORDER_LINES_SQL, doc_labels, order_lines,
)
from vitalis.plans.queries_prep import u_sql
from vitalis.session import materialised


def _order_split(spark, sf):
    ol = order_lines(spark, sf)
    train, test = P.stratified_split(ol, "rid", "returned", 0.2, 42)
    sc = P.scaler_dict(P.fit_scaler(train, ORDER_FEATURES))
    return P.apply_scaler(train, sc), P.apply_scaler(test, sc)


def _fit_eval(spark, sf, model_type, params):
    train, test = _order_split(spark, sf)
    m = ML.fit(model_type, train, ORDER_FEATURES, "returned", params, key="rid")
    scored = ML.predict(m, test.withColumnRenamed("returned", "label"), ORDER_FEATURES, key="rid")
    # written: a row walks through the model once, not once for each count of it
    scored = materialised(scored.select("label", "prob", "prediction"), "test-scores")
    met = V.metrics(scored)
    a = V.auc(scored).withColumn("_k", F.lit(0))
    return rounded(met.withColumn("_k", F.lit(0)).join(a, "_k").drop("_k"))


@register("model_logreg")
def q_logreg(spark, sf):
    return _fit_eval(spark, sf, "logreg", {"C": 1.0})


@register("model_forest")
def q_forest(spark, sf):
    return _fit_eval(spark, sf, "forest", {"trees": 100, "depth": 10})


@register("model_boost")
def q_boost(spark, sf):
    return _fit_eval(spark, sf, "boost", {"trees": 100, "depth": 6, "rate": 0.3})


@register("model_svm_linear")
def q_svm_linear(spark, sf):
    return _fit_eval(spark, sf, "svm", {"kernel": "linear", "C": 1.0})


@register("model_svm_rbf")
def q_svm_rbf(spark, sf):
    return _fit_eval(spark, sf, "svm", {"kernel": "rbf", "C": 1.0, "gamma": "scale"})


@register("model_svm_poly")
def q_svm_poly(spark, sf):
    return _fit_eval(spark, sf, "svm", {"kernel": "poly", "C": 1.0, "gamma": "scale"})


# --- F5: exact k-NN probabilities on the document table --------------------------
_F = ", ".join(DOC_FEATURES)
_D2 = " + ".join(f"(t.{f} - r.{f}) * (t.{f} - r.{f})" for f in DOC_FEATURES)
KNN_SQL = with_ctes(DOC_LABELS_SQL) + f"""
, u AS (SELECT dl.*, {u_sql('CAST(doc_id AS VARCHAR)', "'split'")} AS u FROM dl),
s AS (
  SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY u) <= round(0.2 * count(*) OVER (PARTITION BY toxic)) AS is_test
  FROM u
),
nn AS (
  SELECT t.doc_id, r.toxic AS nb_label,
         row_number() OVER (PARTITION BY t.doc_id ORDER BY {_D2}, r.doc_id) AS rn
  FROM s t JOIN s r ON NOT r.is_test WHERE t.is_test
  QUALIFY rn <= 5
)
SELECT doc_id, round(avg(nb_label), 6) AS prob, CASE WHEN avg(nb_label) > 0.5 THEN 1.0 ELSE 0.0 END AS prediction
FROM nn GROUP BY doc_id"""


@register("model_knn", KNN_SQL)
def q_knn(spark, sf):
    dl = doc_labels(spark, sf)
    train, test = P.stratified_split(dl, "doc_id", "toxic", 0.2, 42)
    m = ML.fit("knn", train, DOC_FEATURES, "toxic", {"k": 5}, key="doc_id")
    out = ML.predict(m, test.select("doc_id", *DOC_FEATURES), DOC_FEATURES, key="doc_id")
    return rounded(out.select("doc_id", "prob", "prediction"))


# --- F6 / F7 / F8 / F9 ----------------------------------------------------------------
@register("random_search_logreg")
def q_search(spark, sf):
    train, _ = _order_split(spark, sf)
    _, best, results = ML.random_search("logreg", train, ORDER_FEATURES, "returned", "rid", n_iter=10, folds=3)
    rows = [(str(sorted(c.items())), float(s), c == best) for c, s in results]
    return spark.createDataFrame(rows, "params string, recall double, best boolean")


_KNN_CANDS = ML.sample_grid(ML.SEARCH_SPACES["knn"], 10, 42)
_KNN_ROWS = ", ".join(f"({i}, $${sorted(c.items())}$$, {c['k']}, '{c['weights']}')" for i, c in enumerate(_KNN_CANDS))
SEARCH_KNN_SQL = with_ctes(DOC_LABELS_SQL) + f"""
, folded AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY toxic ORDER BY {u_sql('CAST(doc_id AS VARCHAR)', "'fold'")}) - 1) % 3 AS INTEGER) AS fold
  FROM dl
),
cand(i, params, k, weights) AS (VALUES {_KNN_ROWS}),
near AS (
  SELECT t.doc_id, t.fold, t.toxic AS truth, r.toxic AS vote, {_D2} AS d2,
         row_number() OVER (PARTITION BY t.doc_id ORDER BY {_D2}, r.doc_id) AS rank
  FROM folded t JOIN folded r ON t.fold <> r.fold
  QUALIFY rank <= 19
),
weighted AS (
  SELECT *, CASE WHEN min(d2) OVER (PARTITION BY doc_id) = 0 THEN CASE WHEN d2 = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 / sqrt(d2) END AS w
  FROM near
),
voted AS (
  SELECT i, fold, doc_id, truth, sum(CASE WHEN weights = 'distance' THEN w ELSE 1.0 END * vote) /
         sum(CASE WHEN weights = 'distance' THEN w ELSE 1.0 END) AS prob
  FROM weighted JOIN cand ON rank <= k GROUP BY ALL
),
recalls AS (
  SELECT i, fold, count_if(truth = 1 AND prob > 0.5) / CAST(count_if(truth = 1) AS DOUBLE) AS r FROM voted GROUP BY ALL
),
scored AS (SELECT i, round(avg(r), 6) AS recall FROM recalls GROUP BY i)
SELECT params, recall, row_number() OVER (ORDER BY recall DESC, cand.i) = 1 AS best FROM scored JOIN cand USING (i)"""


@register("random_search_knn", SEARCH_KNN_SQL)
def q_search_knn(spark, sf):
    dl = doc_labels(spark, sf)
    _, best, results = ML.random_search("knn", dl, DOC_FEATURES, "toxic", "doc_id", n_iter=10, folds=3)
    rows = [(str(sorted(c.items())), float(s), c == best) for c, s in results]
    return rounded(spark.createDataFrame(rows, "params string, recall double, best boolean"))


@register("learning_curve")
def q_curve(spark, sf):
    train, _ = _order_split(spark, sf)
    return rounded(ML.learning_curve("logreg", train, ORDER_FEATURES, "returned", "rid", {"C": 1.0}, cv=5, sizes=5))


@register("permutation_importance")
def q_perm(spark, sf):
    train, test = _order_split(spark, sf)
    m = ML.fit("forest", train, ORDER_FEATURES, "returned", key="rid")
    return rounded(ML.permutation_importance(m, test, ORDER_FEATURES, "returned", "rid", repeats=5, seed=42))


# a fixed linear rule as the model: everything but the fit has its SQL
RULE = {"quantity": 0.02, "price": -0.00001, "discount": 9.0, "tax": -4.0, "total": 0.000002}
RULE_AT = 0.65


def _rule(df):
    z = F.lit(0.0)
    for f, w in RULE.items():
        z = z + F.col(f) * F.lit(w)
    return df.withColumn("prediction", F.when(z > RULE_AT, 1.0).otherwise(0.0))


def _walk_sql(n: str, reps: int) -> str:
    """Recursive SQL for the keyed bijections of the ranks 0 ... n-1, repeat by repeat."""
    keys = ", ".join(f"({r}, {', '.join(f'{m}::BIGINT, {c}::BIGINT' for m, c in round_keys(42, f'perm-{r}'))})" for r in range(reps))
    names = ", ".join(f"m{k}, c{k}" for k in range(4))

    def hashed(v, k):
        return f"((({v} * m{k} + c{k}) % {PRIME}) * (({v} * m{k} + c{k}) % {PRIME}) % {PRIME})"

    state, steps = "x // b AS l0, x % b AS r0", ""
    source = "todo"
    for k in range(4):
        left = f"(l{k} + {hashed(f'r{k}', k)}) % a" if k % 2 == 0 else f"l{k}"
        right = f"r{k}" if k % 2 == 0 else f"(r{k} + {hashed(f'l{k}', k)}) % b"
        steps += f", s{k + 1} AS (SELECT *, {left} AS l{k + 1}, {right} AS r{k + 1} FROM {'s0' if k == 0 else f's{k}'})"
    return f"""keys(rep, {names}) AS (VALUES {keys}),
sizes AS (SELECT {n} AS n, CAST(floor(sqrt({n} - 1)) AS BIGINT) + 1 AS a),
dims AS (SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM sizes),
walk(rep, pos, x, step) AS (
  SELECT rep, pos, pos, 0 FROM keys CROSS JOIN ranked
  UNION ALL
  SELECT rep, pos, x4, step + 1 FROM (
    WITH s0 AS (SELECT w.rep, w.pos, w.step, {state}, a, b, n, {names} FROM walk w JOIN keys k ON k.rep = w.rep CROSS JOIN dims
                WHERE w.step = 0 OR w.x >= n){steps}
    SELECT rep, pos, step, l4 * b + r4 AS x4 FROM s4
  )
),
donor AS (SELECT rep, pos, x AS donor FROM walk CROSS JOIN dims WHERE step > 0 AND x < n)"""


def _rule_sql(values: dict[str, str]) -> str:
    return f"CASE WHEN 0.0 + {' + '.join(f'{values[f]} * CAST({w} AS DOUBLE)' for f, w in RULE.items())} > {RULE_AT} THEN 1 ELSE 0 END"


_OWN = {f: f"o.{f}" for f in RULE}
_PERMUTED = "\n  UNION ALL ".join(
    f"SELECT '{g}' AS feature, rep, avg(CASE WHEN o.returned = {_rule_sql(_OWN | {g: f'd.{g}'})} THEN 1.0 ELSE 0.0 END) AS acc "
    f"FROM donor JOIN ranked o ON o.pos = donor.pos JOIN ranked d ON d.pos = donor.donor GROUP BY rep" for g in RULE)


@register("permutation_importance_rule", with_ctes(ORDER_LINES_SQL).replace("WITH", "WITH RECURSIVE", 1) + f"""
, ranked AS (SELECT *, row_number() OVER (ORDER BY {u_sql('rid', "'perm-base'")}, rid) - 1 AS pos FROM ol),
{_walk_sql('(SELECT count(*) FROM ranked)', 5)},
acc AS (
  {_PERMUTED}
),
base AS (SELECT avg(CASE WHEN o.returned = {_rule_sql(_OWN)} THEN 1.0 ELSE 0.0 END) AS base FROM ranked o)
SELECT feature, round(avg(base - acc), 6) + 0.0 AS importance, round(stddev_pop(acc), 6) AS std FROM acc CROSS JOIN base GROUP BY feature""")
def q_perm_rule(spark, sf):
    return rounded(ML.permutation_importance(_rule, order_lines(spark, sf), ORDER_FEATURES, "returned", "rid", repeats=5, seed=42))


@register("intrinsic_importance")
def q_intrinsic(spark, sf):
    train, _ = _order_split(spark, sf)
    m = ML.fit("forest", train, ORDER_FEATURES, "returned", key="rid")
    return rounded(ML.intrinsic_importance(m, ORDER_FEATURES, spark))
