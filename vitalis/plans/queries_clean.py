"""Queries for sources, cleaning and missing data."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalis.operators import clean as C
from vitalis.operators import missing as M
from vitalis.plans.catalog import register, rounded, with_ctes
from vitalis.plans.fixtures import (
    DIRTY_EVENTS_SQL, ORDER_FEATURES, ORDER_LINES_SQL, dirty_events, order_lines,
)
from vitalis.session import materialised
from vitalis.sources.tables import preview

# --- shared oracle pieces -------------------------------------------------------
COERCED_SQL = """
coerced AS (
  SELECT event_id, try_cast(raw_value AS DOUBLE) AS raw_value, sparse_code, category, num_a, num_b,
         try_cast("Systolic BP" AS DOUBLE) AS "Systolic BP", "DBP", "AGE", outcome
  FROM dirty
)"""

FILLED_SQL = """
modes AS (
  SELECT (SELECT category FROM coerced WHERE category IS NOT NULL
          GROUP BY category ORDER BY count(*) DESC, category LIMIT 1) AS m_cat,
         (SELECT sparse_code FROM coerced WHERE sparse_code IS NOT NULL
          GROUP BY sparse_code ORDER BY count(*) DESC, sparse_code LIMIT 1) AS m_sc
),
filled AS (
  SELECT event_id, raw_value, coalesce(sparse_code, m_sc) AS sparse_code, coalesce(category, m_cat) AS category,
         num_a, num_b, "Systolic BP", "DBP", "AGE", outcome, "Systolic BP" - "DBP" AS "Pulse_Pressure"
  FROM coerced CROSS JOIN modes
),
book AS (
  SELECT 'category' AS "column", label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT category AS label FROM filled)
  UNION ALL
  SELECT 'sparse_code', label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER)
  FROM (SELECT DISTINCT sparse_code AS label FROM filled)
),
cleaned AS (
  SELECT f.event_id, f.raw_value, bs.code AS sparse_code, bc.code AS category, f.num_a, f.num_b,
         f."Systolic BP", f."DBP", f."AGE", f.outcome, f."Pulse_Pressure"
  FROM filled f
  LEFT JOIN book bc ON bc."column" = 'category' AND bc.label = f.category
  LEFT JOIN book bs ON bs."column" = 'sparse_code' AND bs.label = f.sparse_code
)"""


def _cleaned(spark, sf):
    return C.clean(dirty_events(spark, sf))


# --- I3 -------------------------------------------------------------------------
@register("preview_head", with_ctes(DIRTY_EVENTS_SQL) + """
SELECT * FROM dirty ORDER BY event_id LIMIT 5""")
def q_preview(spark, sf):
    return preview(dirty_events(spark, sf), 5, ["event_id"])


# --- P1 / P7 ----------------------------------------------------------------------
@register("drop_identifiers", with_ctes(DIRTY_EVENTS_SQL) + """
SELECT event_id, raw_value, sparse_code, category, num_a, num_b, "Systolic BP", "DBP", "AGE", outcome FROM dirty""")
def q_drop_identifiers(spark, sf):
    return C.drop_identifiers(dirty_events(spark, sf))


@register("drop_columns", with_ctes(DIRTY_EVENTS_SQL) + """
SELECT event_id, "ID", raw_value, sparse_code, category, "Systolic BP", "DBP", "AGE", outcome FROM dirty""")
def q_drop_columns(spark, sf):
    # the three columns with most missing cells after coercion are offered; drop two of them
    return C.drop_columns(dirty_events(spark, sf), ["num_a", "num_b"])


# --- P2 ---------------------------------------------------------------------------
@register("numeric_acceptance", with_ctes(DIRTY_EVENTS_SQL) + """
SELECT "column", round(null_share, 6) AS null_share, coalesce(null_share < 0.9, false) AS accepted FROM (
  SELECT 'ID' AS "column", avg(CASE WHEN try_cast("ID" AS DOUBLE) IS NULL THEN 1.0 ELSE 0.0 END) AS null_share FROM dirty
  UNION ALL SELECT 'raw_value', avg(CASE WHEN try_cast(raw_value AS DOUBLE) IS NULL THEN 1.0 ELSE 0.0 END) FROM dirty
  UNION ALL SELECT 'sparse_code', avg(CASE WHEN try_cast(sparse_code AS DOUBLE) IS NULL THEN 1.0 ELSE 0.0 END) FROM dirty
  UNION ALL SELECT 'category', avg(CASE WHEN try_cast(category AS DOUBLE) IS NULL THEN 1.0 ELSE 0.0 END) FROM dirty
  UNION ALL SELECT 'Systolic BP', avg(CASE WHEN try_cast("Systolic BP" AS DOUBLE) IS NULL THEN 1.0 ELSE 0.0 END) FROM dirty
)""")
def q_numeric_acceptance(spark, sf):
    return rounded(C.numeric_acceptance(dirty_events(spark, sf)))


@register("coerce_numeric", with_ctes(DIRTY_EVENTS_SQL, COERCED_SQL) + """
SELECT event_id, round(raw_value, 6) AS raw_value, sparse_code, category, round(num_a, 6) AS num_a,
       round(num_b, 6) AS num_b, round("Systolic BP", 6) AS "Systolic BP", round("DBP", 6) AS "DBP", "AGE", outcome
FROM coerced""")
def q_coerce(spark, sf):
    return rounded(C.coerce_numeric(C.drop_identifiers(dirty_events(spark, sf))))


# --- P3 ---------------------------------------------------------------------------
@register("add_difference", with_ctes(DIRTY_EVENTS_SQL) + """
SELECT event_id, round(try_cast("Systolic BP" AS DOUBLE), 6) AS "Systolic BP", round("DBP", 6) AS "DBP",
       round(try_cast("Systolic BP" AS DOUBLE) - "DBP", 6) AS "Pulse_Pressure"
FROM dirty""")
def q_add_difference(spark, sf):
    df = dirty_events(spark, sf).select("event_id", "Systolic BP", "DBP")
    return rounded(C.add_difference(df))


# --- P4 ---------------------------------------------------------------------------
@register("column_modes", with_ctes(DIRTY_EVENTS_SQL) + """
SELECT 'category' AS "column", (SELECT category FROM dirty WHERE category IS NOT NULL
        GROUP BY category ORDER BY count(*) DESC, category LIMIT 1) AS mode
UNION ALL
SELECT 'sparse_code', (SELECT sparse_code FROM dirty WHERE sparse_code IS NOT NULL
        GROUP BY sparse_code ORDER BY count(*) DESC, sparse_code LIMIT 1)
UNION ALL
SELECT 'ID', (SELECT "ID" FROM dirty GROUP BY "ID" ORDER BY count(*) DESC, "ID" LIMIT 1)""")
def q_modes(spark, sf):
    return C.column_modes(dirty_events(spark, sf), ["category", "sparse_code", "ID"])


# --- P1-P5 chain --------------------------------------------------------------------
@register("clean_table", with_ctes(DIRTY_EVENTS_SQL, COERCED_SQL, FILLED_SQL) + """
SELECT event_id, round(raw_value, 6) AS raw_value, sparse_code, category, round(num_a, 6) AS num_a,
       round(num_b, 6) AS num_b, round("Systolic BP", 6) AS "Systolic BP", round("DBP", 6) AS "DBP", "AGE",
       outcome, round("Pulse_Pressure", 6) AS "Pulse_Pressure"
FROM cleaned""")
def q_clean(spark, sf):
    out, _ = _cleaned(spark, sf)
    return rounded(out)


@register("codebook", with_ctes(DIRTY_EVENTS_SQL, COERCED_SQL, FILLED_SQL) + """
SELECT "column", label, code FROM book""")
def q_codebook(spark, sf):
    _, book = _cleaned(spark, sf)
    return book


# --- P6 ---------------------------------------------------------------------------
@register("codebook_null_label", with_ctes(DIRTY_EVENTS_SQL) + """
SELECT 'category' AS "column", label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT coalesce(category, 'nan') AS label FROM dirty)""")
def q_codebook_nan(spark, sf):
    return C.fit_codebook(dirty_events(spark, sf), ["category"], null_label=C.NULL_LABEL)


# --- P9 ---------------------------------------------------------------------------
_CORR_UNION = "\n  UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", covar_pop({c}, returned) / NULLIF(stddev_pop({c}) * stddev_pop(returned), 0) AS corr FROM ol"
    for c in ORDER_FEATURES)


@register("suggest_features", with_ctes(ORDER_LINES_SQL) + f"""
SELECT "column", round(corr, 6) AS corr, round(abs(corr), 6) AS abs_corr FROM (
  {_CORR_UNION}
) WHERE corr IS NOT NULL ORDER BY abs(corr) DESC, "column" LIMIT 12""")
def q_suggest(spark, sf):
    return rounded(C.suggest_features(order_lines(spark, sf).drop("rid"), "returned"))


# --- M1 ---------------------------------------------------------------------------
@register("missing_profile", with_ctes(DIRTY_EVENTS_SQL, COERCED_SQL) + """
SELECT "column", n_missing, round(n_missing * 100.0 / n_rows, 6) AS pct FROM (
  SELECT 'raw_value' AS "column", count_if(raw_value IS NULL) AS n_missing, count(*) AS n_rows FROM coerced
  UNION ALL SELECT 'category', count_if(category IS NULL), count(*) FROM coerced
  UNION ALL SELECT 'num_a', count_if(num_a IS NULL), count(*) FROM coerced
  UNION ALL SELECT 'num_b', count_if(num_b IS NULL), count(*) FROM coerced
  UNION ALL SELECT 'sparse_code', count_if(sparse_code IS NULL), count(*) FROM coerced
) WHERE n_missing > 0""")
def q_missing(spark, sf):
    df = C.coerce_numeric(C.drop_identifiers(dirty_events(spark, sf)))
    return rounded(M.missing_profile(df))


# --- M3 / M4 -----------------------------------------------------------------------
_MED_COLS = ["raw_value", "num_a", "num_b", "Systolic BP", "DBP", "Pulse_Pressure"]
_MED_UNION = "\n  UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", quantile_cont(\"{c}\", 0.5) AS median FROM cleaned" for c in _MED_COLS)


@register("feature_medians", with_ctes(DIRTY_EVENTS_SQL, COERCED_SQL, FILLED_SQL) + f"""
SELECT "column", round(median, 6) AS median FROM (
  {_MED_UNION}
)""")
def q_medians(spark, sf):
    out, _ = _cleaned(spark, sf)
    return rounded(M.feature_medians(out, _MED_COLS))


@register("fill_medians", with_ctes(DIRTY_EVENTS_SQL, COERCED_SQL, FILLED_SQL) + """
, med AS (SELECT quantile_cont(raw_value, 0.5) AS m_raw, quantile_cont(num_a, 0.5) AS m_a FROM cleaned)
SELECT event_id, round(coalesce(raw_value, m_raw), 6) AS raw_value, round(coalesce(num_a, m_a), 6) AS num_a,
       round(coalesce(num_b, 0.0), 6) AS num_b
FROM cleaned CROSS JOIN med""")
def q_fill_medians(spark, sf):
    out, _ = _cleaned(spark, sf)
    out = materialised(out, "cleaned")
    med = M.medians_dict(out, ["raw_value", "num_a"])  # one number per feature
    # num_b has no stored median -> filled with 0
    return rounded(M.fill_medians(out.select("event_id", "raw_value", "num_a", "num_b"),
                                  ["raw_value", "num_a", "num_b"], med))
