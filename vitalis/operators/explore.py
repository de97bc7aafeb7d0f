"""Exploration: aggregates, sorts and reshapes.

Each operator is a single aggregate (partial + final HashAggregate) over the
whole table followed by reshaping of a result that has one row per column, per
group or per bin. Exact quantiles go through ``functions.ranking`` so no group
is buffered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalis.functions.brackets import bracket_quantiles
from vitalis.functions.columns import as_double, col, numeric_columns
from vitalis.functions.rng import unit_hash
from vitalis.functions.stats import t_pvalue
from vitalis.session import materialised

MOST_LABELS = 1000  # columns of a cross-tab
CATEGORICAL_BELOW = 10  # fixed: a column with fewer distinct values is categorical


def _stack(row_df: DataFrame, items: list[tuple[str, list[tuple[str, Column]]]]) -> DataFrame:
    """Turn a one-row aggregate into one row per item: ``[(column, [(field, expr)])]``."""
    structs = [F.struct(F.lit(name).alias("column"), *[e.alias(f) for f, e in fields]) for name, fields in items]
    return row_df.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


# --- E1 ----------------------------------------------------------------------
def describe_table(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """count, mean, std (n-1), min, 25/50/75 % (linear), max per numeric column."""
    cols = cols if cols is not None else numeric_columns(df)
    moments = {f"{n}{i}": f(f"_x{i}") for i in range(len(cols)) for n, f in (("m", F.avg), ("s", F.stddev_samp))}
    qs = bracket_quantiles(df, [], cols, [0.25, 0.5, 0.75], extra=moments)

    def own(name):
        """The column's own moment of those that every row carries."""
        return F.element_at(F.array(*[F.col(f"{name}{i}") for i in range(len(cols))]),
                            F.array_position(F.array(*map(F.lit, cols)), F.col("column")).cast("int"))
    return qs.select("column", F.col("n").alias("count"), own("m").alias("mean"), own("s").alias("std"), F.col("lo").alias("min"),
                     F.col("q_0").alias("p25"), F.col("q_1").alias("p50"), F.col("q_2").alias("p75"), F.col("hi").alias("max"))


# --- E2 ----------------------------------------------------------------------
def kpis(df: DataFrame, target: str) -> DataFrame:
    """Total, positives (= sum of the target), positive %, negatives, mean age
    (column whose upper-case name is AGE, else NULL), row and column counts."""
    age = next((c for c in df.columns if c.upper() == "AGE"), None)
    t = as_double(target)
    agg = df.agg(F.count(F.lit(1)).alias("total"), F.sum(t).alias("positives"),
                 (F.avg(as_double(age)) if age else F.lit(None).cast("double")).alias("mean_age"))
    return agg.select(
        F.col("total"),
        F.col("positives"),
        F.try_divide(F.col("positives") * 100.0, F.col("total")).alias("positive_pct"),
        (F.col("total") - F.col("positives")).alias("negatives"),
        F.col("mean_age"),
        F.lit(len(df.columns)).cast("int").alias("n_columns"),
    )


# --- E3 ----------------------------------------------------------------------
def target_correlation(df: DataFrame, target: str, cols: list[str] | None = None) -> DataFrame:
    """Pearson r of each numeric column with the target over pairwise-complete
    rows; NULL for a constant column. Sorted by r descending."""
    cols = [c for c in (cols if cols is not None else numeric_columns(df)) if c != target]
    t = as_double(target)
    aggs = []
    for i, c in enumerate(cols):
        x = as_double(c)
        both = x.isNotNull() & t.isNotNull()
        aggs += [F.covar_pop(x, t).alias(f"cv{i}"),
                 F.stddev_pop(F.when(both, x)).alias(f"sx{i}"),
                 F.stddev_pop(F.when(both, t)).alias(f"st{i}")]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, corr double")
    row = df.agg(*aggs)
    out = _stack(row, [(c, [("corr", F.try_divide(F.col(f"cv{i}"), F.col(f"sx{i}") * F.col(f"st{i}")))])
                       for i, c in enumerate(cols)])
    return out.orderBy(F.desc_nulls_last("corr"), "column")


# --- E4 ----------------------------------------------------------------------
def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of each non-null value, count descending, with percent share."""
    counts = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(col(column)).alias("_total"))  # one row
    return (counts.crossJoin(F.broadcast(total)).select("value", "count", (F.col("count") * 100.0 / F.col("_total")).alias("share"))
            .orderBy(F.desc("count"), "value"))


# --- E5 ----------------------------------------------------------------------
def classify_columns(df: DataFrame, target: str, approx: bool = False) -> DataFrame:
    """Per column: distinct non-null count, numeric flag (numeric and not the
    target), categorical flag (< 10 distinct and not the target)."""
    nums = set(numeric_columns(df))
    cd = F.approx_count_distinct if approx else F.count_distinct
    row = df.agg(*[cd(col(c)).alias(f"d{i}") for i, c in enumerate(df.columns)])
    out = _stack(row, [(c, [("n_distinct", F.col(f"d{i}").cast("long"))]) for i, c in enumerate(df.columns)])
    return out.select(
        "column", "n_distinct",
        F.col("column").isin([c for c in nums if c != target]).alias("numeric"),
        ((F.col("n_distinct") < CATEGORICAL_BELOW) & (F.col("column") != F.lit(target))).alias("categorical"))


# --- E6 ----------------------------------------------------------------------
def _range(df: DataFrame, column: str) -> tuple[float | None, float | None]:
    r = df.agg(F.min(as_double(column)).alias("lo"), F.max(as_double(column)).alias("hi")).first()
    return r["lo"], r["hi"]


def _bin(v: Column, lo: float, hi: float, bins: int) -> Column:
    width = (hi - lo) / bins if hi > lo else 1.0
    return F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, column: str, by: str, bins: int = 20) -> DataFrame:
    """Counts per (group, equal-width bin) over the column's global range; the
    maximum falls in the last bin."""
    lo, hi = _range(df, column)
    if lo is None:
        return df.sparkSession.createDataFrame([], f"grp string, bin int, lower double, upper double, count long")
    width = (hi - lo) / bins if hi > lo else 1.0
    v = as_double(column)
    b = _bin(v, lo, hi, bins)
    out = (df.where(v.isNotNull()).groupBy(col(by).alias("grp"), b.alias("bin"))
           .agg(F.count(F.lit(1)).alias("count")))
    return out.select("grp", "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
                      (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"), "count")


# --- E7 ----------------------------------------------------------------------
def box_stats(df: DataFrame, column: str, by: str) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and outlier count per group."""
    v = as_double(column)
    # written, so that the passes below read two columns and none repeats the joins and sorts that make the table
    base = materialised(df.select(col(by).alias("grp"), v.alias("value")).where(F.col("value").isNotNull()), "box-values")
    qs = bracket_quantiles(base, ["grp"], ["value"], [0.25, 0.5, 0.75]).select(
        F.col("grp").alias("_of"), "q_0", "q_1", "q_2",
        (F.col("q_0") - 1.5 * (F.col("q_2") - F.col("q_0"))).alias("_lf"),
        (F.col("q_2") + 1.5 * (F.col("q_2") - F.col("q_0"))).alias("_uf"))
    # a table of known size: few groups' quartiles are broadcast and no group's rows meet in a task; many groups join by shuffle
    qs = materialised(qs, "box-quartiles")
    j = base.join(qs, base["grp"].eqNullSafe(qs["_of"])).drop("_of")
    inside = (F.col("value") >= F.col("_lf")) & (F.col("value") <= F.col("_uf"))
    return j.groupBy("grp", "q_0", "q_1", "q_2").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("n_outliers"),
    ).select("grp", "n", F.col("q_0").alias("q1"), F.col("q_1").alias("median"), F.col("q_2").alias("q3"),
             "whisker_low", "whisker_high", "n_outliers")


# --- E8 ----------------------------------------------------------------------
def density(df: DataFrame, column: str, by: str, grid: int = 50, bins: int = 200) -> DataFrame:
    """Gaussian kernel density per group on ``grid`` points spanning the global
    range. Rows are first binned (``bins`` fine bins, counts), so the cost is
    groups x bins x grid regardless of row count. Bandwidth per group:
    Silverman, ``0.9 * min(std, IQR/1.34) * n^-0.2``."""
    v = as_double(column)
    base = df.select(col(by).alias("grp"), v.alias("value")).where(F.col("value").isNotNull())
    qs = bracket_quantiles(base, ["grp"], ["value"], [0.25, 0.75], extra={"sd": F.stddev_samp("_x0")})
    lo, hi = qs.agg(F.min("lo"), F.max("hi")).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "grp string, point int, x double, density double")
    span = hi - lo if hi > lo else 1.0
    bw = qs.select(
        F.col("grp").alias("_of"), "n",
        (F.lit(0.9) * F.coalesce(
            F.nullif(F.least(F.col("sd"), (F.col("q_1") - F.col("q_0")) / F.lit(1.34)), F.lit(0.0)),
            F.nullif(F.col("sd"), F.lit(0.0)), F.lit(1.0)) * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"))
    b = F.least(F.floor((F.col("value") - F.lit(lo)) / F.lit(span / bins)), F.lit(bins - 1)).cast("int")
    fine = base.groupBy("grp", b.alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    fine = fine.join(bw, fine["grp"].eqNullSafe(bw["_of"])).drop("_of")
    center = F.lit(lo) + (F.col("bin") + F.lit(0.5)) * F.lit(span / bins)
    step = span / (grid - 1) if grid > 1 else 0.0
    pts = fine.select("grp", "cnt", "n", "h", center.alias("c"),
                      F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
    x = F.lit(lo) + F.col("point") * F.lit(step)
    z = (x - F.col("c")) / F.col("h")
    contrib = F.col("cnt") * F.exp(F.lit(-0.5) * z * z) / (F.col("n") * F.col("h") * F.lit((2 * 3.141592653589793) ** 0.5))
    return (pts.groupBy("grp", "point").agg(F.sum(contrib).alias("density"))
            .select("grp", "point", (F.lit(lo) + F.col("point") * F.lit(step)).alias("x"), "density"))


# --- E9 ----------------------------------------------------------------------
def mean_gap(df: DataFrame, column: str, by: str) -> DataFrame:
    """|mean(first group) - mean(second group)| with groups in key order; no row
    when there are fewer than two groups."""
    means = df.where(col(by).isNotNull()).groupBy(col(by).alias("grp")).agg(F.avg(as_double(column)).alias("m"))
    w = Window.orderBy("grp")  # one row per group
    ranked = means.withColumn("rk", F.row_number().over(w)).where("rk <= 2")
    return ranked.agg(
        F.max(F.when(F.col("rk") == 1, F.col("grp"))).alias("first_group"),
        F.max(F.when(F.col("rk") == 2, F.col("grp"))).alias("second_group"),
        F.abs(F.max(F.when(F.col("rk") == 1, F.col("m"))) - F.max(F.when(F.col("rk") == 2, F.col("m")))).alias("gap"),
        F.count(F.lit(1)).alias("_k"),
    ).where("_k = 2").drop("_k")


# --- E10 / E11 -----------------------------------------------------------------
def crosstab_pct(df: DataFrame, cat: str, target: str) -> DataFrame:
    """Row-normalised cross-tab in percent; one column per target value (text
    of the value), missing cells 0, null keys excluded."""
    base = df.where(col(cat).isNotNull() & col(target).isNotNull())
    base = base.select(col(cat).alias("_cat"), col(target).alias("_v"), col(target).cast("string").alias("_s"))
    # one row per label: they become the columns
    names = [r["_s"] for r in base.select("_v", "_s").distinct().orderBy("_v").limit(MOST_LABELS + 1).collect()]
    if len(names) > MOST_LABELS:
        raise ValueError(f"{target!r} has more than {MOST_LABELS} values, too many for columns of a cross-tab")
    wide = base.groupBy("_cat").pivot("_s", names).agg(F.count(F.lit(1)))
    tot = sum((F.coalesce(col(n), F.lit(0)) for n in names), F.lit(0))
    return wide.select(F.col("_cat").alias(cat),
                       *[(F.coalesce(col(n), F.lit(0)) * 100.0 / tot).alias(n) for n in names])


def melt(df: DataFrame, ids: list[str], name: str, value: str) -> DataFrame:
    """Wide -> long over every non-id column."""
    vals = [c for c in df.columns if c not in ids]
    return df.unpivot([col(i) for i in ids], [col(v) for v in vals], name, value)


# --- E12 ---------------------------------------------------------------------
def scatter3d_points(df: DataFrame, key: str, x: str, y: str, z: str, by: str,
                     max_points: int | None = None, seed: int = 42) -> DataFrame:
    """Points for a 3-axis plot: every row, or with ``max_points`` a deterministic
    hash sample of so many (top-k by md5 fraction: each task keeps k)."""
    u = unit_hash(col(key), seed, "scatter")
    points = (df.select(col(key).alias("key"), as_double(x).alias("x"), as_double(y).alias("y"),
                      as_double(z).alias("z"), col(by).alias("grp"), u.alias("_u")))
    if max_points is not None:
        points = points.orderBy("_u", "key").limit(max_points)
    return points.drop("_u")


# --- E13 ---------------------------------------------------------------------
def t_tests(df: DataFrame, target: str, cols: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Pooled two-sample t-test of every numeric column between the two target
    groups (groups in ascending key order). One grouped aggregate; p from the
    Student-t tail on the one-row-per-column result. Empty unless the target has
    exactly two distinct values (NULL counts as a value)."""
    stats = t_test_stats(df, target, cols)
    judged = stats.withColumn("p", t_pvalue(F.col("t"), F.col("dof"))).withColumn(
        "significant", F.col("p") < F.lit(alpha))
    return judged.withColumn("p", F.round("p", 5))


def t_test_stats(df: DataFrame, target: str, cols: list[str] | None = None) -> DataFrame:
    cols = [c for c in (cols if cols is not None else numeric_columns(df)) if c != target]
    g = df.groupBy(col(target).alias("_g")).agg(*[
        a for i, c in enumerate(cols) for a in (
            F.count(as_double(c)).alias(f"n{i}"), F.avg(as_double(c)).alias(f"m{i}"),
            F.var_samp(as_double(c)).alias(f"v{i}"))
    ])
    # at most a handful of groups: the global window below sees only those rows
    g = g.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy())).where("_k = 2")
    g = g.withColumn("_r", F.row_number().over(Window.orderBy(F.col("_g").asc_nulls_first())))
    long = g.select("_r", "_g", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"),
                 F.col(f"v{i}").alias("v")) for i, c in enumerate(cols)])).alias("s")).select("_r", "_g", "s.*")
    a = long.where("_r = 1").alias("a")
    b = long.where("_r = 2").alias("b")
    j = a.join(b, on="column")
    n1, n2 = F.col("a.n").cast("double"), F.col("b.n").cast("double")
    dof = n1 + n2 - 2
    sp2 = ((n1 - 1) * F.col("a.v") + (n2 - 1) * F.col("b.v")) / dof
    t = F.try_divide(F.col("a.m") - F.col("b.m"), F.sqrt(sp2 * (1 / n1 + 1 / n2)))
    valid = F.col("a._g").isNotNull() & F.col("b._g").isNotNull() & (n1 >= 2) & (n2 >= 2)
    return j.select("column", F.col("a.n").alias("n1"), F.col("b.n").alias("n2"),
                    F.when(valid, t).alias("t"), F.when(valid, dof).alias("dof"))
