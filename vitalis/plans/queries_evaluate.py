"""Queries for evaluation (V1-V7) on the scored-events fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalis.operators import evaluate as V
from vitalis.plans.catalog import register, rounded, with_ctes
from vitalis.plans.fixtures import ORDER_LINES_SQL, SCORED_SQL, order_lines, scored_events


def rates_sql(tp="tp", fp="fp", fn="fn", tn="tn") -> str:
    def div(a, b):
        return f"round(CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END, 6)"
    return ", ".join([
        div(f"{tp} + {tn}", f"{tp} + {fp} + {fn} + {tn}") + " AS accuracy",
        div(tp, f"{tp} + {fn}") + " AS recall",
        div(tp, f"{tp} + {fp}") + " AS precision",
        div(tn, f"{tn} + {fp}") + " AS specificity",
        div(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}") + " AS f1",
        div(f"5 * {tp}", f"5 * {tp} + 4 * {fn} + {fp}") + " AS f2",
    ])


COUNTS_BY_MODEL = """
cnt AS (
  SELECT model, count_if(label = 1 AND prediction = 1) AS tp, count_if(label = 0 AND prediction = 1) AS fp,
         count_if(label = 1 AND prediction = 0) AS fn, count_if(label = 0 AND prediction = 0) AS tn
  FROM sc GROUP BY model
)"""

AUC_BY_MODEL = """
sg AS (SELECT model, prob AS score, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM sc GROUP BY model, prob),
sgc AS (
  SELECT model, score, pos, neg,
         coalesce(sum(neg) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS neg_before
  FROM sg
),
aucs AS (
  SELECT model, CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 0.0
                     ELSE sum(pos * (neg_before + 0.5 * neg)) / (sum(pos) * sum(neg)) END AS auc
  FROM sgc GROUP BY model
)"""


@register("metrics", with_ctes(SCORED_SQL, COUNTS_BY_MODEL) + f"""
SELECT model, tp, fp, fn, tn, {rates_sql()} FROM cnt""")
def q_metrics(spark, sf):
    return rounded(V.metrics(scored_events(spark, sf), by=["model"]))


@register("auc", with_ctes(SCORED_SQL, AUC_BY_MODEL) + """
SELECT model, round(auc, 6) AS auc FROM aucs""")
def q_auc(spark, sf):
    return rounded(V.auc(scored_events(spark, sf), by=["model"]))


THRESH_SQL = """
th AS (SELECT CAST(i AS INTEGER) AS i, CAST(i AS DOUBLE) / 100.0 AS threshold FROM range(0, 101) r(i)),
tc AS (
  SELECT th.threshold, count_if(label = 1 AND prob >= th.threshold) AS tp,
         count_if(label <> 1 AND prob >= th.threshold) AS fp,
         count_if(label = 1 AND prob < th.threshold) AS fn, count_if(label <> 1 AND prob < th.threshold) AS tn
  FROM th CROSS JOIN sc GROUP BY th.threshold
)"""


@register("threshold_metrics", with_ctes(SCORED_SQL, THRESH_SQL) + f"""
SELECT round(threshold, 6) AS threshold, tp, fp, fn, tn, {rates_sql()} FROM tc""")
def q_threshold(spark, sf):
    return rounded(V.threshold_metrics(scored_events(spark, sf)))


@register("confusion", with_ctes(SCORED_SQL) + """
SELECT CAST(label AS INTEGER) AS actual, CAST(p AS INTEGER) AS predicted, count(*) AS "count" FROM (
  SELECT label, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS p FROM sc
) GROUP BY 1, 2""")
def q_confusion(spark, sf):
    return V.confusion(scored_events(spark, sf), 0.5)


@register("roc_curve", with_ctes(SCORED_SQL) + """
, g AS (SELECT prob AS score, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM sc GROUP BY prob),
c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM g),
t AS (SELECT sum(pos) AS p, sum(neg) AS n FROM g)
SELECT CAST(NULL AS DOUBLE) AS score, 0.0 AS fpr, 0.0 AS tpr
UNION ALL
SELECT round(score, 6), round(CAST(fp AS DOUBLE) / n, 6), round(CAST(tp AS DOUBLE) / p, 6) FROM c CROSS JOIN t""")
def q_roc(spark, sf):
    return rounded(V.roc_curve(scored_events(spark, sf)))


# continuous scores: nearly as many distinct values as rows, in the groups of a tax rate
LINE_SCORES_SQL = """
sc AS (SELECT tax AS model, price / 120000.0 AS prob, CAST(returned AS DOUBLE) AS label FROM ol)"""


def _line_scores(spark, sf):
    return order_lines(spark, sf).select(F.col("tax").alias("model"), (F.col("price") / 120000.0).alias("prob"),
                                         F.col("returned").cast("double").alias("label"))


@register("auc_continuous", with_ctes(ORDER_LINES_SQL, LINE_SCORES_SQL, AUC_BY_MODEL) + """
SELECT round(model, 6) AS model, round(auc, 6) AS auc FROM aucs""")
def q_auc_continuous(spark, sf):
    return rounded(V.auc(_line_scores(spark, sf), by=["model"]))


@register("roc_continuous", with_ctes(ORDER_LINES_SQL, LINE_SCORES_SQL) + """
, g AS (SELECT prob AS score, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM sc GROUP BY prob),
c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM g),
t AS (SELECT sum(pos) AS p, sum(neg) AS n FROM g)
SELECT CAST(NULL AS DOUBLE) AS score, 0.0 AS fpr, 0.0 AS tpr
UNION ALL
SELECT score, CAST(fp AS DOUBLE) / n, CAST(tp AS DOUBLE) / p FROM c CROSS JOIN t""")
def q_roc_continuous(spark, sf):
    return V.roc_curve(_line_scores(spark, sf))  # the same divisions in both engines


_BIN = " + ".join(f"CAST(prob > CAST({j} AS DOUBLE) * CAST(0.1 AS DOUBLE) AS INTEGER)" for j in range(1, 10))


@register("calibration", with_ctes(SCORED_SQL) + f"""
SELECT CAST({_BIN} AS INTEGER) AS bin, round(avg(prob), 6) AS mean_prob,
       round(avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END), 6) AS positive_share, count(*) AS n
FROM sc GROUP BY 1""")
def q_calibration(spark, sf):
    return rounded(V.calibration(scored_events(spark, sf)))


@register("decision_curve", with_ctes(SCORED_SQL) + """
, th AS (
  SELECT CASE WHEN i = 99 THEN CAST(0.99 AS DOUBLE)
              ELSE CAST(0.01 AS DOUBLE) + CAST(i AS DOUBLE) * ((CAST(0.99 AS DOUBLE) - CAST(0.01 AS DOUBLE)) / 99.0)
         END AS t
  FROM range(0, 100) r(i)
),
c AS (
  SELECT t, count_if(label = 1 AND prob >= t) AS tp, count_if(label <> 1 AND prob >= t) AS fp,
         count(*) AS n, count_if(label = 1) AS pos
  FROM th CROSS JOIN sc GROUP BY t
)
SELECT round(t, 6) AS threshold, round(CAST(tp AS DOUBLE) / n - CAST(fp AS DOUBLE) / n * (t / (1 - t)), 6) AS net_benefit,
       round(CAST(pos AS DOUBLE) / n - (1 - CAST(pos AS DOUBLE) / n) * (t / (1 - t)), 6) AS treat_all,
       0.0 AS treat_none
FROM c""")
def q_decision(spark, sf):
    return rounded(V.decision_curve(scored_events(spark, sf)))
