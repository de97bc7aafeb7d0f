"""Queries for split, scale, rebalance and KNN imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalis.operators import clean as C
from vitalis.operators import missing as M
from vitalis.operators import prep as P
from vitalis.operators import rebalance as R
from vitalis.plans.catalog import register, rounded, with_ctes
from vitalis.plans.fixtures import (
    DIRTY_EVENTS_SQL, DOC_FEATURES, DOC_LABELS_SQL, ORDER_FEATURES, ORDER_LINES_SQL,
    dirty_events, doc_labels, order_lines,
)
from vitalis.plans.queries_clean import COERCED_SQL


def u_sql(key: str, salt: str, seed: int = 42) -> str:
    """The md5 fraction of ``functions.rng.unit_hash`` in SQL."""
    return (f"(CAST(('0x' || substr(md5({key} || '|{seed}|' || {salt}), 1, 13)) AS BIGINT)"
            f" / 4503599627370496.0)")


# --- T1 ----------------------------------------------------------------------
@register("stratified_split", with_ctes(ORDER_LINES_SQL) + f"""
, u AS (SELECT rid, returned, {u_sql('rid', "'split'")} AS u FROM ol)
SELECT rid, returned,
       row_number() OVER (PARTITION BY returned ORDER BY u) <= round(0.2 * count(*) OVER (PARTITION BY returned))
         AS is_test
FROM u""")
def q_split(spark, sf):
    return P.split_flags(order_lines(spark, sf).select("rid", "returned"), "rid", "returned", 0.2, 42)


@register("stratified_folds", with_ctes(ORDER_LINES_SQL) + f"""
, u AS (SELECT rid, returned, {u_sql('rid', "'fold'")} AS u FROM ol)
SELECT rid, returned, CAST((row_number() OVER (PARTITION BY returned ORDER BY u) - 1) % 3 AS INTEGER) AS fold
FROM u""")
def q_folds(spark, sf):
    return P.stratified_folds(order_lines(spark, sf).select("rid", "returned"), "rid", "returned", 3, 42)


# --- T6 ----------------------------------------------------------------------
_SCALER = "\n  UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", avg({c}) AS mean, CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1.0 "
    f"ELSE stddev_pop({c}) END AS scale FROM ol" for c in ORDER_FEATURES)
SCALER_SQL = f"sc AS (\n  {_SCALER}\n)"


@register("fit_scaler", with_ctes(ORDER_LINES_SQL, SCALER_SQL) + """
SELECT "column", round(mean, 4) AS mean, round(scale, 4) AS scale FROM sc""")
def q_fit_scaler(spark, sf):
    return rounded(P.fit_scaler(order_lines(spark, sf), ORDER_FEATURES), 4)


_APPLY = ", ".join(
    f"round(({c} - (SELECT mean FROM sc WHERE \"column\" = '{c}')) / (SELECT scale FROM sc WHERE \"column\" = '{c}'), 6) AS {c}"
    for c in ORDER_FEATURES)


@register("apply_scaler", with_ctes(ORDER_LINES_SQL, SCALER_SQL) + f"""
SELECT rid, {_APPLY}, returned FROM ol""")
def q_apply_scaler(spark, sf):
    ol = order_lines(spark, sf).cache()
    sc = P.fit_scaler(ol, ORDER_FEATURES)
    return rounded(P.apply_scaler(ol, sc))


# --- T2 ----------------------------------------------------------------------
def _d2_sql(a: str, b: str, feats: list[str]) -> str:
    return " + ".join(f"({a}.{f} - {b}.{f}) * ({a}.{f} - {b}.{f})" for f in feats)


_F = ", ".join(DOC_FEATURES)
_COUNTS = "cnt AS (SELECT count_if(toxic = 1) AS n_mi, count_if(toxic = 0) AS n_ma FROM dl)"
_MINORITY = f"mi AS (SELECT CAST(doc_id AS VARCHAR) AS k, {_F} FROM dl WHERE toxic = 1)"
_BASE = f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, {', '.join(f'round({f}, 6) AS {f}' for f in DOC_FEATURES)}, toxic FROM dl"


def _by_rank(table: str) -> str:
    """The new rows spread over the seeds of a table: as many each, one more for the smallest fractions."""
    return f"""qr AS (SELECT s.*, row_number() OVER (ORDER BY {u_sql('k', "'quota'")}) AS r, count(*) OVER () AS n FROM {table} s),
seeds AS (
  SELECT qr.*, CAST((n_ma - n_mi) // n + CASE WHEN r <= (n_ma - n_mi) % n THEN 1 ELSE 0 END AS INTEGER) AS quota
  FROM qr CROSS JOIN cnt
)"""


def _nearest_sql(k: int) -> str:
    """The k nearest rows of the whole table to each minority row, with their class."""
    return f"""near AS (
  SELECT a.k AS ak, b.toxic AS bt,
         row_number() OVER (PARTITION BY a.k ORDER BY {_d2_sql('a', 'b', DOC_FEATURES)}, b.k) AS rank
  FROM mi a JOIN (SELECT CAST(doc_id AS VARCHAR) AS k, {_F}, toxic FROM dl) b ON a.k <> b.k
  QUALIFY rank <= {k}
)"""


# new rows from ``seeds`` (k, features, quota): copies, each between its seed and one of five minority neighbours
_SAMPLES = f"""nn AS (
  SELECT a.k AS ak, b.k AS bk, {', '.join(f'b.{f} AS b_{f}' for f in DOC_FEATURES)},
         row_number() OVER (PARTITION BY a.k ORDER BY {_d2_sql('a', 'b', DOC_FEATURES)}, b.k) AS rank
  FROM mi a JOIN mi b ON a.k <> b.k
  QUALIFY rank <= 5
),
na AS (SELECT ak, count(*) AS na FROM nn GROUP BY ak),
copies AS (SELECT s.*, unnest(range(0, s.quota)) AS cp FROM seeds s WHERE s.quota > 0),
picked AS (
  SELECT c.*, na.na,
         CAST(floor({u_sql('c.k', "'nb|' || CAST(c.cp AS VARCHAR)")} * na.na) + 1 AS BIGINT) AS rank,
         {u_sql('c.k', "'gap|' || CAST(c.cp AS VARCHAR)")} AS gap
  FROM copies c JOIN na ON na.ak = c.k
),
made AS (
  SELECT p.k || '#' || CAST(p.cp AS VARCHAR) AS doc_id,
         {', '.join(f'round(p.{f} + p.gap * (nn.b_{f} - p.{f}), 6) AS {f}' for f in DOC_FEATURES)},
         1 AS toxic
  FROM picked p JOIN nn ON nn.ak = p.k AND nn.rank = p.rank
)"""
_SMOTE = ",\n".join([_MINORITY, _COUNTS, _by_rank("mi"), _SAMPLES])
SMOTE_SQL = with_ctes(DOC_LABELS_SQL, _SMOTE) + "\nSELECT * FROM made"
SMOTE_FULL_SQL = with_ctes(DOC_LABELS_SQL, _SMOTE) + f"\n{_BASE} UNION ALL SELECT * FROM made"
_DANGER = """danger AS (
  SELECT mi.* FROM mi JOIN (SELECT ak FROM near GROUP BY ak HAVING count_if(bt <> 1) * 2 >= 10 AND count_if(bt <> 1) < 10) d
    ON d.ak = mi.k
)"""
BORDERLINE_SQL = with_ctes(DOC_LABELS_SQL, _MINORITY, _COUNTS, _nearest_sql(10), _DANGER, _by_rank("danger"), _SAMPLES) + \
    f"\n{_BASE} UNION ALL SELECT * FROM made"
ADASYN_SQL = with_ctes(DOC_LABELS_SQL, _MINORITY, _COUNTS, _nearest_sql(5), """ratio AS (
  SELECT ak, count_if(bt <> 1) / 5.0::DOUBLE AS r FROM near GROUP BY ak
),
seeds AS (
  SELECT mi.*, CAST(round_even(r / (SELECT sum(r) FROM ratio) * CAST(n_ma - n_mi AS DOUBLE), 0) AS INTEGER) AS quota
  FROM mi JOIN ratio ON ratio.ak = mi.k CROSS JOIN cnt
)""", _SAMPLES) + f"\n{_BASE} UNION ALL SELECT * FROM made"


@register("smote_samples", SMOTE_SQL)
def q_smote(spark, sf):
    return rounded(R.smote_samples(doc_labels(spark, sf), "doc_id", DOC_FEATURES, "toxic", k=5, seed=42))


@register("smote", SMOTE_FULL_SQL)
def q_smote_full(spark, sf):
    return rounded(R.smote(doc_labels(spark, sf), "doc_id", DOC_FEATURES, "toxic", k=5, seed=42))


@register("adasyn", ADASYN_SQL)
def q_adasyn(spark, sf):
    return rounded(R.adasyn(doc_labels(spark, sf), "doc_id", DOC_FEATURES, "toxic", k=5, seed=42))


@register("borderline_smote", BORDERLINE_SQL)
def q_borderline(spark, sf):
    return rounded(R.borderline_smote(doc_labels(spark, sf), "doc_id", DOC_FEATURES, "toxic", k=5, m=10, seed=42))


_DANGER_SQL = with_ctes(DOC_LABELS_SQL) + f"""
, al AS (SELECT CAST(doc_id AS VARCHAR) AS k, {_F}, toxic FROM dl),
nn AS (
  SELECT a.k AS ak, b.toxic AS bt,
         row_number() OVER (PARTITION BY a.k ORDER BY {_d2_sql('a', 'b', DOC_FEATURES)}, b.k) AS rank
  FROM al a JOIN al b ON a.k <> b.k WHERE a.toxic = 1
  QUALIFY rank <= 10
)
SELECT ak AS doc_id FROM nn GROUP BY ak HAVING count_if(bt <> 1) * 2 >= 10 AND count_if(bt <> 1) < 10"""


@register("danger_set", _DANGER_SQL)
def q_danger(spark, sf):
    return R.danger_set(doc_labels(spark, sf), "doc_id", DOC_FEATURES, "toxic", m=10).select("doc_id")


@register("rebalance_fallback", BORDERLINE_SQL)
def q_rebalance(spark, sf):
    # Borderline-SMOTE with SMOTE fallback when the danger set is empty
    return rounded(R.rebalance(doc_labels(spark, sf), "borderline", "doc_id", DOC_FEATURES, "toxic", seed=42))


# the classes far apart: no minority row has a majority neighbour, so both samplers give way to SMOTE
_APART = "dl AS (SELECT * REPLACE (n_chars + 10000000.0 * toxic AS n_chars) FROM near_dl)"
_APART_SQL = with_ctes(DOC_LABELS_SQL.replace("dl AS", "near_dl AS", 1), _APART, _SMOTE) + f"\n{_BASE} UNION ALL SELECT * FROM made"


def _apart(spark, sf):
    return doc_labels(spark, sf).withColumn("n_chars", F.col("n_chars") + 10000000.0 * F.col("toxic"))


@register("rebalance_empty_danger", _APART_SQL)
def q_rebalance_empty(spark, sf):
    return rounded(R.rebalance(_apart(spark, sf), "borderline", "doc_id", DOC_FEATURES, "toxic", seed=42))


@register("rebalance_adasyn_apart", _APART_SQL)
def q_rebalance_adasyn(spark, sf):
    return rounded(R.rebalance(_apart(spark, sf), "adasyn", "doc_id", DOC_FEATURES, "toxic", seed=42))


# --- M2 ----------------------------------------------------------------------
_IMP_COLS = ["raw_value", "num_a", "num_b", "Systolic BP", "DBP", "AGE", "outcome"]
_X = [f"x{i}" for i in range(len(_IMP_COLS))]


def _pick(alias: str) -> str:
    return "CASE r.c " + " ".join(f"WHEN {i} THEN {alias}.x{i}" for i in range(len(_X))) + " END"


_S = "0.0 + " + " + ".join(
    f"CASE WHEN r.{x} IS NOT NULL AND d.{x} IS NOT NULL THEN (r.{x} - d.{x}) * (r.{x} - d.{x}) ELSE 0.0 END" for x in _X)
_N = "0 + " + " + ".join(f"CASE WHEN r.{x} IS NOT NULL AND d.{x} IS NOT NULL THEN 1 ELSE 0 END" for x in _X)
_RQ = "\n  UNION ALL ".join(f"SELECT {i} AS c, * FROM b WHERE x{i} IS NULL" for i in range(len(_X)))
_FINAL = ", ".join(
    f"round(coalesce(b.x{i}, (SELECT v FROM imp WHERE imp.key = b.key AND imp.c = {i}), (SELECT avg(x{i}) FROM b)), 6)"
    f" AS \"{c}\"" for i, c in enumerate(_IMP_COLS))

KNN_IMPUTE_SQL = with_ctes(DIRTY_EVENTS_SQL, COERCED_SQL) + f"""
, b AS (
  SELECT event_id AS key, raw_value AS x0, num_a AS x1, num_b AS x2, "Systolic BP" AS x3, "DBP" AS x4,
         CAST("AGE" AS DOUBLE) AS x5, CAST(outcome AS DOUBLE) AS x6
  FROM coerced
),
rq AS (
  {_RQ}
),
pairs AS (
  SELECT r.key, r.c, d.key AS dk, {_pick('d')} AS val,
         CASE WHEN ({_N}) > 0 THEN (CAST({len(_X)} AS DOUBLE) / ({_N})) * ({_S}) END AS d2
  FROM rq r JOIN b d ON {_pick('d')} IS NOT NULL
),
imp AS (
  SELECT key, c, avg(val) AS v FROM (
    SELECT key, c, val, row_number() OVER (PARTITION BY key, c ORDER BY d2, dk) AS rn
    FROM pairs WHERE d2 IS NOT NULL
  ) WHERE rn <= 5 GROUP BY key, c
)
SELECT b.key AS event_id, {_FINAL} FROM b"""


@register("knn_impute", KNN_IMPUTE_SQL)
def q_knn_impute(spark, sf):
    df = C.coerce_numeric(C.drop_identifiers(dirty_events(spark, sf)))
    df = df.select("event_id", *_IMP_COLS)
    return rounded(M.knn_impute(df, "event_id", _IMP_COLS, k=5))
