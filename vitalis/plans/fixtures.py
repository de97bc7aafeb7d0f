"""TESTDATA analogues of the clinical tables.

There is no clinical table in TESTDATA, so each operator family runs on a
derived table built from the given ones. Every derivation exists twice: as a
DataFrame (used by the queries) and as an SQL CTE (used by the DuckDB
oracles). Both read whole tables; nulls and text markers are injected with
fixed modulus rules on the row id (TESTDATA has no NULLs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalis.sources.tables import read_testdata


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patient-like raw table: an identifier, a numeric column with an
    ``EMPTY`` marker, a 90 %-unparseable code column, a text category with
    nulls, numeric columns with nulls, systolic/diastolic pair, AGE and a 0/1
    outcome."""
    e = read_testdata(spark, sf_dir, "events")
    eid = F.col("event_id")
    return e.select(
        eid,
        F.concat(F.lit("E"), eid.cast("string")).alias("ID"),
        F.when(eid % 5 == 0, F.lit("EMPTY")).otherwise(F.col("value").cast("string")).alias("raw_value"),
        F.when(eid % 10 == 0, F.col("user_id").cast("string")).otherwise(F.lit("n/a")).alias("sparse_code"),
        F.when(eid % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("event_type")).alias("category"),
        F.when(eid % 11 == 0, F.lit(None).cast("double")).otherwise(F.col("value")).alias("num_a"),
        F.when(eid % 13 == 0, F.lit(None).cast("double")).otherwise(F.col("user_id").cast("double")).alias("num_b"),
        (F.col("user_id") % 50 + 100).cast("string").alias("Systolic BP"),
        (F.col("user_id") % 30 + 60).cast("double").alias("DBP"),
        (F.col("user_id") % 60 + 20).cast("int").alias("AGE"),
        F.when(eid % 3 == 0, F.lit(1)).otherwise(F.lit(0)).alias("outcome"),
    )


DIRTY_EVENTS_SQL = """
dirty AS (
  SELECT event_id,
         'E' || CAST(event_id AS VARCHAR) AS "ID",
         CASE WHEN event_id % 5 = 0 THEN 'EMPTY' ELSE CAST(value AS VARCHAR) END AS raw_value,
         CASE WHEN event_id % 10 = 0 THEN CAST(user_id AS VARCHAR) ELSE 'n/a' END AS sparse_code,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS category,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS num_a,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS num_b,
         CAST(user_id % 50 + 100 AS VARCHAR) AS "Systolic BP",
         CAST(user_id % 30 + 60 AS DOUBLE) AS "DBP",
         CAST(user_id % 60 + 20 AS INTEGER) AS "AGE",
         CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS outcome
  FROM events
)"""


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary outcome with numeric features: lineitem joined to orders,
    outcome = returned (flag R). ``rid`` is an md5 of the 5-column unique key."""
    li = read_testdata(spark, sf_dir, "lineitem")
    o = read_testdata(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"], "inner")
    rid = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                            F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")))
    return j.select(
        rid.alias("rid"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.col("o_totalprice").alias("total"),
        F.when(F.col("l_returnflag") == "R", F.lit(1)).otherwise(F.lit(0)).alias("returned"),
    )


ORDER_LINES_SQL = """
ol AS (
  SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                       CAST(round(l_extendedprice * 100) AS BIGINT))) AS rid,
         l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
         o_totalprice AS total,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

ORDER_FEATURES = ["quantity", "price", "discount", "tax", "total"]


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imbalanced outcome: documents joined to labels, y = toxic; features from
    the whole text (chars, words, lines, digit share)."""
    d = read_testdata(spark, sf_dir, "documents")
    lab = read_testdata(spark, sf_dir, "labels")
    # the features first: no text goes through the join's shuffle and sort
    features = d.select(*_doc_columns())
    return features.join(lab.select("doc_id", F.col("toxic").cast("int").alias("toxic")), "doc_id", "inner")


def doc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of ``doc_labels`` of every document, labelled or not."""
    return read_testdata(spark, sf_dir, "documents").select(*_doc_columns())


def _doc_columns() -> list[Column]:
    t = F.col("text")
    n = F.length(t)
    return [
        F.col("doc_id"),
        F.col("n_chars").cast("double").alias("n_chars"),
        (n - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("double").alias("n_words"),
        (n - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("double").alias("n_lines"),
        F.try_divide((n - F.length(F.regexp_replace(t, "[0-9]", ""))).cast("double"), n.cast("double")).alias("digit_share"),
    ]


DOC_LABELS_SQL = """
dl AS (
  SELECT d.doc_id,
         CAST(d.n_chars AS DOUBLE) AS n_chars,
         CAST(length(d.text) - length(replace(d.text, ' ', '')) + 1 AS DOUBLE) AS n_words,
         CAST(length(d.text) - length(replace(d.text, chr(10), '')) + 1 AS DOUBLE) AS n_lines,
         CAST(length(d.text) - length(regexp_replace(d.text, '[0-9]', '', 'g')) AS DOUBLE)
             / NULLIF(CAST(length(d.text) AS DOUBLE), 0) AS digit_share,
         CAST(l.toxic AS INTEGER) AS toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""

DOC_FEATURES = ["n_chars", "n_words", "n_lines", "digit_share"]


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored set without a model: ``prob`` and ``label`` from fixed rules on
    the event id, ``model`` = event type (five "models")."""
    e = read_testdata(spark, sf_dir, "events")
    eid = F.col("event_id")
    prob = ((eid * 37) % 101).cast("double") / F.lit(101.0)
    return e.select(
        eid.alias("key"), F.col("event_type").alias("model"), F.col("ts"),
        prob.alias("prob"),
        F.when(eid % 3 == 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("label"),
        F.when(prob >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0)).alias("prediction"),
    )


SCORED_SQL = """
sc AS (
  SELECT event_id AS key, event_type AS model, ts,
         CAST((event_id * 37) % 101 AS DOUBLE) / 101.0 AS prob,
         CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS label,
         CASE WHEN CAST((event_id * 37) % 101 AS DOUBLE) / 101.0 >= 0.5 THEN 1.0 ELSE 0.0 END AS prediction
  FROM events
)"""
