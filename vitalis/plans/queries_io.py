"""Queries for sources/sinks (I1, I2, I5) and the streaming scoring path."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from vitalis.operators import clean as C
from vitalis.operators import missing as M
from vitalis.plans.catalog import register, rounded, with_ctes
from vitalis.plans.fixtures import DIRTY_EVENTS_SQL, dirty_events
from vitalis.plans.queries_clean import COERCED_SQL, FILLED_SQL
from vitalis.plans.queries_score import _SCORE_SQL, SCORE_FEATURES, scoring_package
from vitalis.session import checkpoint_dir, materialised
from vitalis.sources.tables import read_table, read_testdata, require_columns, write_clean_csv
from vitalis.streaming import scoring as ST


def _scratch(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


# --- I1: CSV in, everything as text, then P2 -----------------------------------------
@register("csv_source", with_ctes(DIRTY_EVENTS_SQL) + """
SELECT try_cast(CAST(event_id AS VARCHAR) AS DOUBLE) AS event_id, "ID", try_cast(raw_value AS DOUBLE) AS raw_value,
       sparse_code, category, round(num_a, 6) AS num_a, round(num_b, 6) AS num_b,
       try_cast("Systolic BP" AS DOUBLE) AS "Systolic BP", "DBP", CAST("AGE" AS DOUBLE) AS "AGE",
       CAST(outcome AS DOUBLE) AS outcome
FROM dirty""")
def q_csv_source(spark, sf):
    path = _scratch(spark, "csv")
    dirty_events(spark, sf).write.mode("overwrite").option("header", True).csv(path)
    raw = read_table(spark, path, fmt="csv")  # all text
    return rounded(C.coerce_numeric(raw))


# --- I2: clean CSV sink (gate: no missing cell) ------------------------------------------
@register("clean_csv_sink", with_ctes(DIRTY_EVENTS_SQL, COERCED_SQL, FILLED_SQL) + """
, med AS (SELECT quantile_cont(raw_value, 0.5) AS m_raw, quantile_cont(num_a, 0.5) AS m_a, quantile_cont(num_b, 0.5) AS m_b FROM cleaned)
SELECT CAST(event_id AS DOUBLE) AS event_id, round(coalesce(raw_value, m_raw), 6) AS raw_value,
       CAST(sparse_code AS DOUBLE) AS sparse_code, CAST(category AS DOUBLE) AS category, round(coalesce(num_a, m_a), 6) AS num_a, round(coalesce(num_b, m_b), 6) AS num_b,
       round("Systolic BP", 6) AS "Systolic BP", round("DBP", 6) AS "DBP",
       CAST("AGE" AS DOUBLE) AS "AGE", CAST(outcome AS DOUBLE) AS outcome, round("Pulse_Pressure", 6) AS "Pulse_Pressure"
FROM cleaned CROSS JOIN med""")
def q_csv_sink(spark, sf):
    cleaned, _ = C.clean(dirty_events(spark, sf))
    cleaned = materialised(cleaned, "cleaned")
    med = M.medians_dict(cleaned, ["raw_value", "num_a", "num_b"])
    complete = M.fill_medians(cleaned, ["raw_value", "num_a", "num_b"], med)
    path = _scratch(spark, "clean-csv")
    write_clean_csv(complete, path)
    return rounded(C.coerce_numeric(read_table(spark, path, fmt="csv")))  # all text


# --- I5 ------------------------------------------------------------------------------------
@register("require_columns", with_ctes(DIRTY_EVENTS_SQL) + """
SELECT event_id, raw_value, num_a, num_b, category FROM dirty""")
def q_require(spark, sf):
    df = dirty_events(spark, sf)
    return require_columns(df, SCORE_FEATURES).select("event_id", *SCORE_FEATURES)


# --- streaming: the scoring plan on a file stream -------------------------------------------
@register("stream_score", _SCORE_SQL + """
SELECT event_id, round(prob, 6) AS prob, round(risk_pct, 6) AS risk_pct,
       CASE WHEN risk_pct > 50 THEN 'positive' ELSE 'negative' END AS verdict,
       CASE WHEN risk_pct > 80 THEN 'urgent' WHEN risk_pct > 50 THEN 'monitor' ELSE 'maintain' END AS action,
       CASE WHEN risk_pct > 75 THEN '75-100' WHEN risk_pct > 50 THEN '50-75' ELSE '0-50' END AS band
FROM out""")
def q_stream(spark, sf):
    """Score the dirty events as a file stream: the events parquet file is the
    stream source (``availableNow``), the sink a parquet folder."""
    pkg = scoring_package(spark, sf)
    schema = read_testdata(spark, sf, "events").schema
    src = ST.read_record_stream(spark, sf, schema, glob="events.parquet")
    eid = F.col("event_id")
    records = src.select(
        eid,
        F.when(eid % 5 == 0, F.lit("EMPTY")).otherwise(F.col("value").cast("string")).alias("raw_value"),
        F.when(eid % 11 == 0, F.lit(None).cast("double")).otherwise(F.col("value")).alias("num_a"),
        F.when(eid % 13 == 0, F.lit(None).cast("double")).otherwise(F.col("user_id").cast("double")).alias("num_b"),
        F.when(eid % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("event_type")).alias("category"))
    out = _scratch(spark, "stream-out")
    qry = ST.run_to_parquet(ST.scored_stream(records, pkg, "event_id"), out, uuid.uuid4().hex)
    qry.awaitTermination()
    return rounded(spark.read.parquet(out).select("event_id", "prob", "risk_pct", "verdict", "action", "band"))
