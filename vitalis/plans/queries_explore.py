"""Queries for exploration."""

from __future__ import annotations

from vitalis.operators import explore as E
from vitalis.plans.catalog import register, rounded, with_ctes
from vitalis.plans.fixtures import (
    DIRTY_EVENTS_SQL, ORDER_FEATURES, ORDER_LINES_SQL, dirty_events, order_lines,
)

_LONG = "\n  UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS value FROM ol" for c in ORDER_FEATURES)
LONG_SQL = f"long AS (\n  {_LONG}\n)"

# money-scale columns keep 2 decimals so float summation order cannot show
MONEY = 2


@register("describe_table", with_ctes(ORDER_LINES_SQL, LONG_SQL) + f"""
SELECT col AS "column", count(value) AS "count", round(avg(value), {MONEY}) AS mean,
       round(stddev_samp(value), {MONEY}) AS std, round(min(value), 6) AS "min",
       round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS "max"
FROM long GROUP BY col""")
def q_describe(spark, sf):
    out = E.describe_table(order_lines(spark, sf), ORDER_FEATURES)
    return rounded(out, 6, {"mean": MONEY, "std": MONEY})


@register("kpis", with_ctes(DIRTY_EVENTS_SQL) + """
SELECT count(*) AS total, CAST(sum(outcome) AS DOUBLE) AS positives,
       round(sum(outcome) * 100.0 / count(*), 6) AS positive_pct,
       CAST(count(*) - sum(outcome) AS DOUBLE) AS negatives,
       round(avg("AGE"), 6) AS mean_age, CAST(11 AS INTEGER) AS n_columns
FROM dirty""")
def q_kpis(spark, sf):
    return rounded(E.kpis(dirty_events(spark, sf), "outcome"))


_CORR = "\n  UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", covar_pop({c}, returned) / NULLIF(stddev_pop({c}) * stddev_pop(returned), 0) AS corr FROM ol"
    for c in ORDER_FEATURES)
CORR_SQL = with_ctes(ORDER_LINES_SQL) + f"""
SELECT "column", round(corr, 6) AS corr FROM (
  {_CORR}
)"""


@register("target_correlation", CORR_SQL)
def q_corr(spark, sf):
    return rounded(E.target_correlation(order_lines(spark, sf), "returned", ORDER_FEATURES))


@register("value_counts", with_ctes(DIRTY_EVENTS_SQL) + """
SELECT category AS value, count(*) AS "count", round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share
FROM dirty WHERE category IS NOT NULL GROUP BY category""")
def q_value_counts(spark, sf):
    return rounded(E.value_counts(dirty_events(spark, sf), "category"))


_DIRTY_COLS = ["event_id", "ID", "raw_value", "sparse_code", "category", "num_a", "num_b",
               "Systolic BP", "DBP", "AGE", "outcome"]
_DIRTY_NUMERIC = ["event_id", "num_a", "num_b", "DBP", "AGE"]
_DISTINCT = "\n  UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT \"{c}\") AS n_distinct FROM dirty"
                                  for c in _DIRTY_COLS)


@register("classify_columns", with_ctes(DIRTY_EVENTS_SQL) + f"""
SELECT "column", n_distinct, "column" IN ({', '.join("'" + c + "'" for c in _DIRTY_NUMERIC)}) AS numeric,
       (n_distinct < 10 AND "column" <> 'outcome') AS categorical
FROM (
  {_DISTINCT}
)""")
def q_classify(spark, sf):
    return E.classify_columns(dirty_events(spark, sf), "outcome")


_RANGE = "rng AS (SELECT min(price) AS lo, max(price) AS hi FROM ol)"


@register("histogram", with_ctes(ORDER_LINES_SQL, _RANGE) + """
SELECT grp, bin, round(lo + bin * w, 6) AS lower, round(lo + (bin + 1) * w, 6) AS upper, count(*) AS "count"
FROM (
  SELECT returned AS grp, lo, CASE WHEN hi > lo THEN (hi - lo) / 20 ELSE 1.0 END AS w,
         CAST(least(floor((price - lo) / (CASE WHEN hi > lo THEN (hi - lo) / 20 ELSE 1.0 END)), 19) AS INTEGER) AS bin
  FROM ol CROSS JOIN rng
) GROUP BY grp, bin, lo, w""")
def q_histogram(spark, sf):
    return rounded(E.histogram(order_lines(spark, sf), "price", "returned", bins=20))


@register("box_stats", with_ctes(ORDER_LINES_SQL) + """
, q AS (
  SELECT returned AS grp, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS med,
         quantile_cont(price, 0.75) AS q3
  FROM ol GROUP BY returned
)
SELECT q.grp, count(*) AS n, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
       round(min(CASE WHEN price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN price END), 6) AS whisker_low,
       round(max(CASE WHEN price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN price END), 6) AS whisker_high,
       count(CASE WHEN NOT (price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) THEN 1 END) AS n_outliers
FROM ol JOIN q ON ol.returned = q.grp GROUP BY q.grp, q1, med, q3""")
def q_box(spark, sf):
    return rounded(E.box_stats(order_lines(spark, sf), "price", "returned"))


@register("density", with_ctes(ORDER_LINES_SQL) + """
, rng AS (SELECT min(discount) AS lo, max(discount) AS hi, CASE WHEN max(discount) > min(discount)
                 THEN max(discount) - min(discount) ELSE 1.0 END AS span FROM ol),
bw AS (
  SELECT returned AS grp, count(*) AS n,
         0.9 * coalesce(NULLIF(least(stddev_samp(discount),
                                     (quantile_cont(discount, 0.75) - quantile_cont(discount, 0.25)) / 1.34), 0),
                        NULLIF(stddev_samp(discount), 0), 1.0) * pow(CAST(count(*) AS DOUBLE), -0.2) AS h
  FROM ol GROUP BY returned
),
fine AS (
  SELECT returned AS grp, CAST(least(floor((discount - lo) / (span / 200)), 199) AS INTEGER) AS bin, count(*) AS cnt
  FROM ol CROSS JOIN rng GROUP BY 1, 2
),
pts AS (SELECT CAST(range AS INTEGER) AS point FROM range(0, 50))
SELECT f.grp, p.point, round(lo + p.point * (span / 49), 6) AS x,
       round(sum(cnt * exp(-0.5 * pow(((lo + p.point * (span / 49)) - (lo + (bin + 0.5) * (span / 200))) / h, 2))
                 / (n * h * sqrt(2 * pi()))), 6) AS density
FROM fine f JOIN bw ON f.grp = bw.grp CROSS JOIN rng CROSS JOIN pts p
GROUP BY f.grp, p.point, lo, span""")
def q_density(spark, sf):
    return rounded(E.density(order_lines(spark, sf), "discount", "returned", grid=50, bins=200))


@register("mean_gap", with_ctes(ORDER_LINES_SQL) + """
, m AS (SELECT returned AS grp, avg(price) AS mean FROM ol GROUP BY returned)
SELECT min(grp) AS first_group, max(grp) AS second_group,
       round(abs(max(CASE WHEN grp = 0 THEN mean END) - max(CASE WHEN grp = 1 THEN mean END)), 2) AS gap
FROM m""")
def q_mean_gap(spark, sf):
    return rounded(E.mean_gap(order_lines(spark, sf), "price", "returned"), 2)


CROSSTAB_SQL = with_ctes(DIRTY_EVENTS_SQL) + """
, c AS (
  SELECT category, outcome, count(*) AS n FROM dirty
  WHERE category IS NOT NULL AND outcome IS NOT NULL GROUP BY 1, 2
),
w AS (
  SELECT category,
         coalesce(sum(CASE WHEN outcome = 0 THEN n END), 0) AS n0,
         coalesce(sum(CASE WHEN outcome = 1 THEN n END), 0) AS n1
  FROM c GROUP BY category
)"""


@register("crosstab_pct", CROSSTAB_SQL + """
SELECT category, round(n0 * 100.0 / (n0 + n1), 6) AS "0", round(n1 * 100.0 / (n0 + n1), 6) AS "1" FROM w""")
def q_crosstab(spark, sf):
    return rounded(E.crosstab_pct(dirty_events(spark, sf), "category", "outcome"))


@register("melt_crosstab", CROSSTAB_SQL + """
SELECT category, '0' AS outcome, round(n0 * 100.0 / (n0 + n1), 6) AS "Percentage" FROM w
UNION ALL
SELECT category, '1', round(n1 * 100.0 / (n0 + n1), 6) FROM w""")
def q_melt(spark, sf):
    ct = E.crosstab_pct(dirty_events(spark, sf), "category", "outcome")
    return rounded(E.melt(ct, ["category"], "outcome", "Percentage"))


@register("scatter3d_points", with_ctes(ORDER_LINES_SQL) + """
SELECT rid AS key, round(quantity, 6) AS x, round(price, 6) AS y, round(discount, 6) AS z, returned AS grp
FROM ol""")
def q_scatter(spark, sf):
    return rounded(E.scatter3d_points(order_lines(spark, sf), "rid", "quantity", "price", "discount", "returned"))


_T = "\n  UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", returned AS g, count({c}) AS n, avg({c}) AS m, var_samp({c}) AS v FROM ol GROUP BY returned"
    for c in ORDER_FEATURES)


@register("t_test_stats", with_ctes(ORDER_LINES_SQL) + f"""
, s AS (
  {_T}
)
SELECT a."column", a.n AS n1, b.n AS n2,
       round((a.m - b.m) / sqrt((((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) * (1.0 / a.n + 1.0 / b.n)), 6) AS t,
       round(CAST(a.n + b.n - 2 AS DOUBLE), 6) AS dof
FROM s a JOIN s b ON a."column" = b."column" AND a.g = 0 AND b.g = 1""")
def q_t_stats(spark, sf):
    return rounded(E.t_test_stats(order_lines(spark, sf), "returned", ORDER_FEATURES))


# the p value by Simpson's rule over the tail of Student's density, x = |t| + u / (1 - u), 4 000 steps
_TAIL = """CASE WHEN t IS NOT NULL THEN (
  SELECT least(1.0, 2.0 * sum(w * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2) - 0.5 * ln(dof * pi())
         - (dof + 1) / 2 * ln(1 + pow(abs(t) + u / (1 - u), 2) / dof)) / ((1 - u) * (1 - u))) / 12000.0)
  FROM (SELECT i / 4000.0::DOUBLE AS u, CASE WHEN i = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w
        FROM range(0, 4000) r(i))
) END"""


@register("t_tests", with_ctes(ORDER_LINES_SQL) + f"""
, s AS (
  {_T}
),
j AS (
  SELECT a."column", a.n AS n1, b.n AS n2,
         (a.m - b.m) / sqrt((((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) * (1.0 / a.n + 1.0 / b.n)) AS t,
         CAST(a.n + b.n - 2 AS DOUBLE) AS dof
  FROM s a JOIN s b ON a."column" = b."column" AND a.g = 0 AND b.g = 1
), p AS (SELECT *, {_TAIL} AS p FROM j)
SELECT "column", n1, n2, round(t, 6) AS t, round(dof, 6) AS dof, round(p, 5) AS p, p < 0.05 AS significant FROM p""")
def q_t_tests(spark, sf):
    return rounded(E.t_tests(order_lines(spark, sf), "returned", ORDER_FEATURES))
