"""Queries for registry (G1-G8), packages (I4, G7) and batch scoring with
explanation (S1-S10).

Scoring uses a package whose model is a fixed logistic formula (so the whole
pipeline — codebook, medians, scaler, probability, verdict — has an exact SQL
oracle); codebook, medians and scaler are fitted by Spark on the cleaned table.
"""

from __future__ import annotations

import dataclasses
import os
import uuid

from pyspark.sql import functions as F

from vitalis.operators import clean as C
from vitalis.operators import explain as X
from vitalis.operators import missing as M
from vitalis.operators import models as ML
from vitalis.operators import prep as P
from vitalis.operators import registry as G
from vitalis.operators import score as S
from vitalis.operators import training as T
from vitalis.operators.tree_shapley import forest_shapley
from vitalis.plans.catalog import register, rounded, with_ctes
from vitalis.plans.fixtures import (
    DIRTY_EVENTS_SQL, DOC_FEATURES, SCORED_SQL, dirty_events, doc_features, doc_labels, scored_events,
)
from vitalis.plans.queries_clean import COERCED_SQL, FILLED_SQL
from vitalis.plans.queries_evaluate import AUC_BY_MODEL, COUNTS_BY_MODEL, rates_sql
from vitalis.session import checkpoint_dir, materialised
from vitalis.sources.packages import Package, active_info, load_package, promote, register_package, save_package

# ============================ registry ===========================================
HISTORY_SQL = f"""
{COUNTS_BY_MODEL.strip()},
{AUC_BY_MODEL.strip()},
hist AS (
  SELECT c.model || ' (Auto) - ' || strftime(t.ts, '%H:%M:%S') AS run_id, c.model,
         {rates_sql('c.tp', 'c.fp', 'c.fn', 'c.tn')}, round(a.auc, 6) AS auc,
         CAST(5 AS INTEGER) AS n_features, CAST(NULL AS DOUBLE) AS threshold, t.ts
  FROM cnt c JOIN aucs a ON a.model = c.model JOIN (SELECT model, max(ts) AS ts FROM sc GROUP BY model) t ON t.model = c.model
)"""

_NEW_RUNS_SQL = f"""
new_cnt AS (
  SELECT model, count_if(label = 1 AND prob >= 0.6) AS tp, count_if(label = 0 AND prob >= 0.6) AS fp,
         count_if(label = 1 AND prob < 0.6) AS fn, count_if(label = 0 AND prob < 0.6) AS tn
  FROM sc WHERE model IN ('click', 'error') GROUP BY model
),
new_runs AS (
  SELECT c.model || ' (Manual) - ' || strftime(t.ts + INTERVAL 1 DAY, '%H:%M:%S') AS run_id, c.model || ' (Manual)' AS model,
         {rates_sql('c.tp', 'c.fp', 'c.fn', 'c.tn')}, round(a.auc, 6) AS auc,
         CAST(5 AS INTEGER) AS n_features, CAST(0.6 AS DOUBLE) AS threshold, t.ts + INTERVAL 1 DAY AS ts
  FROM new_cnt c JOIN aucs a ON a.model = c.model JOIN (SELECT model, max(ts) AS ts FROM sc GROUP BY model) t ON t.model = c.model
)"""


def _history(spark, sf):
    return rounded(G.run_rows(scored_events(spark, sf), "Auto", 5))


def _new_runs(spark, sf):
    sc = scored_events(spark, sf).where(F.col("model").isin("click", "error"))
    sc = sc.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    runs = rounded(G.run_rows(sc, "Manual", 5, threshold=0.6))
    return runs.withColumn("model", F.concat(F.col("model"), F.lit(" (Manual)")))


HIST_COLS = "run_id, model, accuracy, recall, precision, f1, f2, auc, n_features, threshold, ts"


@register("run_history", with_ctes(SCORED_SQL, HISTORY_SQL) + f"""
SELECT {HIST_COLS} FROM hist""")
def q_history(spark, sf):
    return _history(spark, sf)


@register("upsert_run", with_ctes(SCORED_SQL, HISTORY_SQL, _NEW_RUNS_SQL) + f"""
SELECT run_id, trim(split_part(model, '(', 1)) AS model, accuracy, recall, precision, f1, f2, auc, n_features,
       threshold, ts
FROM (SELECT * FROM hist UNION ALL SELECT * FROM new_runs)
QUALIFY row_number() OVER (PARTITION BY trim(split_part(model, '(', 1)) ORDER BY ts DESC, run_id DESC) = 1""")
def q_upsert(spark, sf):
    return G.upsert_run(_history(spark, sf), _new_runs(spark, sf))


@register("delete_run", with_ctes(SCORED_SQL, HISTORY_SQL) + f"""
SELECT {HIST_COLS} FROM hist WHERE model <> 'view'""")
def q_delete(spark, sf):
    return G.delete_run(_history(spark, sf), "view")


@register("retune_run", with_ctes(SCORED_SQL, HISTORY_SQL) + f"""
, rt AS (
  SELECT count_if(label = 1 AND prob >= 0.3) AS tp, count_if(label = 0 AND prob >= 0.3) AS fp,
         count_if(label = 1 AND prob < 0.3) AS fn, count_if(label = 0 AND prob < 0.3) AS tn
  FROM sc WHERE model = 'click'
),
rm AS (SELECT {rates_sql()} FROM rt)
SELECT h.run_id, h.model,
       CASE WHEN h.model = 'click' THEN rm.accuracy ELSE h.accuracy END AS accuracy,
       CASE WHEN h.model = 'click' THEN rm.recall ELSE h.recall END AS recall,
       CASE WHEN h.model = 'click' THEN rm.precision ELSE h.precision END AS precision,
       CASE WHEN h.model = 'click' THEN rm.f1 ELSE h.f1 END AS f1,
       CASE WHEN h.model = 'click' THEN rm.f2 ELSE h.f2 END AS f2,
       h.auc, h.n_features, CASE WHEN h.model = 'click' THEN 0.3 ELSE h.threshold END AS threshold, h.ts
FROM hist h CROSS JOIN rm""")
def q_retune(spark, sf):
    sc = scored_events(spark, sf).where(F.col("model") == "click")
    met = rounded(V_metrics_at(sc, 0.3))
    return G.retune_run(_history(spark, sf), "click", met, 0.3)


def V_metrics_at(df, t):
    from vitalis.operators import evaluate as V
    return V.metrics(df, threshold=t)


_W = G.DEFAULT_WEIGHTS


@register("leaderboard", with_ctes(SCORED_SQL, HISTORY_SQL) + f"""
SELECT {HIST_COLS}, coalesce(f2, 0.0) AS score,
       CAST(row_number() OVER (ORDER BY coalesce(f2, 0.0) DESC, ts ASC) AS INTEGER) AS rank
FROM hist""")
def q_leaderboard(spark, sf):
    return G.leaderboard(_history(spark, sf))


_WSCORE = (f"(0.0 + coalesce(recall, 0.0) * {_W['recall'] / 100.0} + coalesce(precision, 0.0) * {_W['precision'] / 100.0}"
           f" + coalesce(f1, 0.0) * {_W['f1'] / 100.0} + coalesce(accuracy, 0.0) * {_W['accuracy'] / 100.0})")


@register("leaderboard_weighted", with_ctes(SCORED_SQL, HISTORY_SQL) + f"""
SELECT {HIST_COLS}, round({_WSCORE}, 6) AS score,
       CAST(row_number() OVER (ORDER BY {_WSCORE} DESC, ts ASC) AS INTEGER) AS rank
FROM hist""")
def q_leaderboard_w(spark, sf):
    return rounded(G.leaderboard(_history(spark, sf), dict(_W)))


@register("radar", with_ctes(SCORED_SQL, HISTORY_SQL) + """
, lb AS (SELECT *, CAST(row_number() OVER (ORDER BY coalesce(f2, 0.0) DESC, ts ASC) AS INTEGER) AS rank FROM hist)
SELECT rank, model, metric, value FROM (
  SELECT rank, model, 'accuracy' AS metric, coalesce(accuracy, 0.0) AS value FROM lb
  UNION ALL SELECT rank, model, 'recall', coalesce(recall, 0.0) FROM lb
  UNION ALL SELECT rank, model, 'precision', coalesce(precision, 0.0) FROM lb
  UNION ALL SELECT rank, model, 'f1', coalesce(f1, 0.0) FROM lb
  UNION ALL SELECT rank, model, 'f2', coalesce(f2, 0.0) FROM lb
) WHERE rank <= 3""")
def q_radar(spark, sf):
    return G.radar(_history(spark, sf))


@register("candidate_vs_active", with_ctes(SCORED_SQL, HISTORY_SQL) + """
, lb AS (SELECT run_id AS package, *, coalesce(f2, 0.0) AS score,
                CAST(row_number() OVER (ORDER BY coalesce(f2, 0.0) DESC, ts ASC) AS INTEGER) AS rank FROM hist),
act AS (SELECT * FROM hist WHERE model = 'view')
SELECT lb.package, lb.model, lb.rank, lb.score, lb.accuracy, lb.recall, lb.precision, lb.f1, lb.f2, lb.auc,
       round(lb.accuracy - act.accuracy, 6) AS delta_accuracy, round(lb.recall - act.recall, 6) AS delta_recall,
       round(lb.precision - act.precision, 6) AS delta_precision, round(lb.f1 - act.f1, 6) AS delta_f1,
       round(lb.f2 - act.f2, 6) AS delta_f2, round(lb.auc - act.auc, 6) AS delta_auc
FROM lb CROSS JOIN act WHERE lb.rank = 1""")
def q_candidate(spark, sf):
    h = _history(spark, sf).cache()
    reg = h.withColumnRenamed("ts", "saved_at").withColumn("package", F.col("run_id"))
    active = h.where(F.col("model") == "view")
    return rounded(G.candidate_vs_active(reg, active))


@register("reevaluate", with_ctes(SCORED_SQL) + f"""
, c AS (
  SELECT count_if(label = 1 AND prob >= 0.5) AS tp, count_if(label = 0 AND prob >= 0.5) AS fp,
         count_if(label = 1 AND prob < 0.5) AS fn, count_if(label = 0 AND prob < 0.5) AS tn FROM sc
),
g AS (SELECT prob, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM sc GROUP BY prob),
gc AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
       FROM g),
a AS (SELECT CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 0.0 ELSE sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg)) END AS auc
      FROM gc)
SELECT tp, fp, fn, tn, {rates_sql()}, round(a.auc, 6) AS auc FROM c CROSS JOIN a""")
def q_reevaluate(spark, sf):
    return rounded(G.reevaluate(scored_events(spark, sf).select("label", "prob")))


# ============================ scoring ============================================
SCORE_FEATURES = ["raw_value", "num_a", "num_b", "category"]
# fixed values: the logistic formula used as the stored model of the scoring queries
LINEAR = {"intercept": -0.5, "coefficients": {"raw_value": 0.8, "num_a": -0.4, "num_b": 0.3, "category": 0.2}}


def scoring_package(spark, sf) -> Package:
    cleaned, book = C.clean(dirty_events(spark, sf))
    cleaned = materialised(cleaned, "cleaned")
    med = M.medians_dict(cleaned, SCORE_FEATURES)
    sc = P.scaler_dict(P.fit_scaler(cleaned, SCORE_FEATURES))
    imp = {f: abs(v) for f, v in LINEAR["coefficients"].items()}
    return Package(model_type="linear", model=None, features=SCORE_FEATURES, target="outcome", scaler=sc,
                   medians=med, codebook=book.where(F.col("column") == "category").cache(), linear=LINEAR,
                   importance=imp)


def _scored(spark, sf):
    return S.score(dirty_events(spark, sf), scoring_package(spark, sf), "event_id")


_Z = " + ".join(
    [f"CAST({LINEAR['intercept']} AS DOUBLE)"]
    + [f"CAST({LINEAR['coefficients'][f]} AS DOUBLE) * ((f.{f} - s.a_{f}) / s.s_{f})" for f in SCORE_FEATURES])
_SCALE = ", ".join(
    f"avg({f}) AS a_{f}, CASE WHEN coalesce(stddev_pop({f}), 0) = 0 THEN 1.0 ELSE stddev_pop({f}) END AS s_{f}"
    for f in SCORE_FEATURES)
_MISS = ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in SCORE_FEATURES)

SCORED_BATCH_SQL = f"""
med AS (SELECT {', '.join(f'quantile_cont({f}, 0.5) AS m_{f}' for f in SCORE_FEATURES)} FROM cleaned),
scl AS (SELECT {_SCALE} FROM cleaned),
enc AS (
  SELECT d.event_id, try_cast(d.raw_value AS DOUBLE) AS raw_value, d.num_a, d.num_b, CAST(b.code AS DOUBLE) AS category
  FROM dirty d LEFT JOIN book b ON b."column" = 'category' AND b.label = d.category
),
miss AS (SELECT *, list_filter([{_MISS}], lambda x: x IS NOT NULL) AS missing_cols FROM enc),
f AS (
  SELECT event_id, {', '.join(f'coalesce({f}, m_{f}) AS {f}' for f in SCORE_FEATURES)}, missing_cols
  FROM miss CROSS JOIN med
),
scored AS (
  SELECT f.*, 1.0 / (1.0 + exp(-({_Z}))) AS prob FROM f CROSS JOIN scl s
),
out AS (
  SELECT event_id, {', '.join(SCORE_FEATURES)}, missing_cols, prob,
         CASE WHEN prob > 0.5 THEN 1.0 ELSE 0.0 END AS prediction, round_even(prob * 100.0, 2) AS risk_pct
  FROM scored
)"""

_SCORE_SQL = with_ctes(DIRTY_EVENTS_SQL, COERCED_SQL, FILLED_SQL, SCORED_BATCH_SQL)
_R6 = ", ".join(f"round({f}, 6) AS {f}" for f in SCORE_FEATURES)


@register("score_batch", _SCORE_SQL + f"""
SELECT event_id, {_R6}, missing_cols, round(prob, 6) AS prob, prediction, round(risk_pct, 6) AS risk_pct FROM out""")
def q_score(spark, sf):
    return rounded(_scored(spark, sf))


@register("encode_for_scoring", with_ctes(DIRTY_EVENTS_SQL, COERCED_SQL, FILLED_SQL) + """
SELECT d.event_id, round(try_cast(d.raw_value AS DOUBLE), 6) AS raw_value, round(d.num_a, 6) AS num_a,
       round(d.num_b, 6) AS num_b, CAST(b.code AS DOUBLE) AS category
FROM dirty d LEFT JOIN book b ON b."column" = 'category' AND b.label = d.category""")
def q_encode(spark, sf):
    pkg = scoring_package(spark, sf)
    x = S.select_features(dirty_events(spark, sf), "event_id", SCORE_FEATURES)
    return rounded(S.encode_for_scoring(x, SCORE_FEATURES, pkg.codebook))


_LABEL = ("'Record ' || CAST(event_id AS VARCHAR) || ' - Risk: ' || CAST(risk_pct AS VARCHAR) || '%' || "
          "CASE WHEN len(missing_cols) > 0 THEN ' (missing/invalid values)' ELSE '' END")


@register("patient_labels", _SCORE_SQL + f"""
SELECT event_id, {_LABEL} AS label_view FROM out""")
def q_labels(spark, sf):
    return S.patient_label(_scored(spark, sf), "event_id").select("event_id", "label_view")


@register("verdicts", _SCORE_SQL + """
SELECT event_id, round(risk_pct, 6) AS risk_pct,
       CASE WHEN risk_pct > 50 THEN 'positive' ELSE 'negative' END AS verdict,
       round(greatest(prob, 1.0 - prob) * 100.0, 6) AS confidence,
       CASE WHEN risk_pct > 80 THEN 'urgent' WHEN risk_pct > 50 THEN 'monitor' ELSE 'maintain' END AS action,
       CASE WHEN risk_pct > 75 THEN '75-100' WHEN risk_pct > 50 THEN '50-75' ELSE '0-50' END AS band
FROM out""")
def q_verdicts(spark, sf):
    v = S.verdict(_scored(spark, sf))
    return rounded(v.select("event_id", "risk_pct", "verdict", "confidence", "action", "band"))


@register("patient_drilldown", _SCORE_SQL + f"""
SELECT event_id, {_R6}, {_LABEL} AS label_view FROM out
WHERE {_LABEL} = (SELECT {_LABEL} FROM out ORDER BY event_id LIMIT 1)""")
def q_patient(spark, sf):
    lab = S.patient_label(_scored(spark, sf), "event_id").cache()
    first = lab.orderBy("event_id").select("label_view").first()["label_view"]  # the picked record
    return rounded(S.patient(lab, first).select("event_id", *SCORE_FEATURES, "label_view"))


_CMP = "\n  UNION ALL ".join(
    f"SELECT event_id, '{f}' AS feature, CAST({abs(LINEAR['coefficients'][f])} AS DOUBLE) AS importance, "
    f"{f} AS value, coalesce((SELECT m_{f} FROM med), 0.0) AS typical FROM out" for f in SCORE_FEATURES)


@register("compare_to_typical", _SCORE_SQL + f"""
, cmp AS (
  {_CMP}
),
d AS (SELECT *, CASE WHEN typical <> 0 THEN (value - typical) / typical * 100.0 END AS diff_pct FROM cmp)
SELECT event_id, feature, round(importance, 6) AS importance, round(value, 6) AS value, round(typical, 6) AS typical,
       round(diff_pct, 6) AS diff_pct,
       CASE WHEN diff_pct IS NULL THEN 'N/A'
            WHEN abs(diff_pct) > 10 THEN (CASE WHEN diff_pct > 0 THEN 'high (' ELSE 'low (' END)
                 || CAST(CAST(round_even(abs(diff_pct), 0) AS BIGINT) AS VARCHAR) || '%)'
            ELSE 'normal' END AS assessment
FROM d""")
def q_compare(spark, sf):
    pkg = scoring_package(spark, sf)
    scored = S.score(dirty_events(spark, sf), pkg, "event_id")
    return rounded(S.compare_to_typical(scored, "event_id", pkg.importance, pkg.medians))


def _shapley_sql(method: str) -> str:
    """Every coalition as a hybrid row, weighted and added up."""
    weights = X.coalition_weights(SCORE_FEATURES, method)
    table = ", ".join(f"({m}, [{', '.join(repr(x) for x in w)}])" for m, w in sorted(weights.items()))
    hybrid = ", ".join(f"CASE WHEN mask & {1 << i} <> 0 THEN f.{f} ELSE coalesce((SELECT m_{f} FROM med), 0.0) END AS {f}"
                       for i, f in enumerate(SCORE_FEATURES))
    parts = "\n  UNION ALL ".join(
        f"SELECT event_id, '{f}' AS feature, sum(w[{i + 1}] * prob) AS contribution, max(CASE WHEN mask = 0 THEN prob END) AS base "
        f"FROM h GROUP BY event_id" for i, f in enumerate(SCORE_FEATURES))
    return _SCORE_SQL + f"""
, coalition(mask, w) AS (VALUES {table}),
hyb AS (SELECT event_id, mask, w, {hybrid} FROM out f CROSS JOIN coalition),
h AS (SELECT f.event_id, mask, w, 1.0 / (1.0 + exp(-({_Z}))) AS prob FROM hyb f CROSS JOIN scl s)
SELECT event_id, feature, round(contribution, 6) + 0.0 AS contribution, round(base, 6) AS base FROM (
  {parts}
)"""


@register("shapley_exact", _shapley_sql("exact"))
def q_shapley(spark, sf):
    pkg = scoring_package(spark, sf)
    scored = S.score(dirty_events(spark, sf), pkg, "event_id")
    fn = X.linear_prob_fn(SCORE_FEATURES, pkg.scaler, LINEAR)
    return rounded(X.shapley(scored, "event_id", SCORE_FEATURES, pkg.medians, fn))


@register("shapley_sampled", _shapley_sql("sampled"))
def q_shapley_sampled(spark, sf):
    pkg = scoring_package(spark, sf)
    scored = S.score(dirty_events(spark, sf), pkg, "event_id")
    fn = X.linear_prob_fn(SCORE_FEATURES, pkg.scaler, LINEAR)
    return rounded(X.shapley(scored, "event_id", SCORE_FEATURES, pkg.medians, fn, method="sampled"))


@register("shapley_forest")
def q_shapley_forest(spark, sf):
    """A forest fitted on the labelled documents; every document explained by its trees."""
    forest = ML.fit("forest", doc_labels(spark, sf), DOC_FEATURES, "toxic")
    return rounded(forest_shapley(doc_features(spark, sf), "doc_id", DOC_FEATURES, forest))


# ============================ packages (I4 / G7) ===================================
@register("package_roundtrip")
def q_package(spark, sf):
    """Fit a logistic model on the labelled documents, save the package to the
    shared checkpoint folder, load it back and score every document, labelled or not."""
    dl = doc_labels(spark, sf)
    train, test = P.stratified_split(dl, "doc_id", "toxic", 0.2, 42)
    train = train.cache()
    sc = P.scaler_dict(P.fit_scaler(train, DOC_FEATURES))
    m = ML.fit("logreg", P.apply_scaler(train, sc), DOC_FEATURES, "toxic", {"C": 1.0})
    pkg = Package(model_type="logreg", model=m, features=DOC_FEATURES, target="toxic", scaler=sc,
                  medians=M.medians_dict(dl, DOC_FEATURES))
    path = os.path.join(checkpoint_dir(spark), f"package-{uuid.uuid4().hex}")
    back = load_package(spark, save_package(pkg, path))
    return rounded(S.verdict(S.score(doc_features(spark, sf), back, "doc_id")).select("doc_id", "prob", "risk_pct", "verdict"))


# two candidates that differ in the intercept; the better one of the run history is promoted last
_CANDIDATES = {"click": 0.0, "view": 0.5}


@register("promotion_lifecycle", with_ctes(DIRTY_EVENTS_SQL, COERCED_SQL, FILLED_SQL, SCORED_BATCH_SQL, SCORED_SQL, HISTORY_SQL) + f"""
, best AS (
  SELECT model FROM hist WHERE model IN ('click', 'view') ORDER BY coalesce(f2, 0.0) DESC, ts LIMIT 1
)
SELECT event_id, best.model AS package, 2 AS version,
       round(1.0 / (1.0 + exp(-({_Z} + CASE WHEN best.model = 'view' THEN 0.5 ELSE 0.0 END))), 6) AS prob
FROM out f CROSS JOIN scl s CROSS JOIN best""")
def q_promotion(spark, sf):
    """Register two packages, rank them, promote the worse and then the better one, score with what is active."""
    folder = os.path.join(checkpoint_dir(spark), f"registry-{uuid.uuid4().hex}")
    registry, table = os.path.join(folder, "registry"), dirty_events(spark, sf)
    cleaned = materialised(C.clean(table)[0], "cleaned")
    base = scoring_package(spark, sf)
    ranked = [r["model"] for r in G.leaderboard(_history(spark, sf).where(F.col("model").isin(list(_CANDIDATES)))).orderBy("rank").collect()]
    for name in reversed(ranked):
        linear = LINEAR | {"intercept": LINEAR["intercept"] + _CANDIDATES[name]}
        pkg = dataclasses.replace(base, linear=linear)
        register_package(spark, registry, pkg, name, os.path.join(folder, name))
        promote(spark, registry, pkg, name, os.path.join(folder, name), cleaned)
    active = active_info(spark, registry).first()
    scored = S.score(table, load_package(spark, active["path"]), "event_id")
    return rounded(scored.select("event_id", F.lit(active["package"]).alias("package"),
                                 F.lit(active["version"]).cast("int").alias("version"), "prob"))


@register("training_run")
def q_training_run(spark, sf):
    """Split, SMOTE, scale, search, evaluate and keep a logistic model on the labelled documents."""
    run = T.train_run(doc_labels(spark, sf), T.RunConfig("logreg", DOC_FEATURES, "toxic", "doc_id", name="logistic", sampler="smote",
                                                          candidates=5))
    counts = [F.lit(n).cast("long").alias(f"n_{k}") for k, n in run.counts.items()]
    return rounded(run.history.select("model", *G.METRICS, "n_features", *counts))
