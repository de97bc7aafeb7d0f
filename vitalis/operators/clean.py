"""Projection, cleaning and encoding.

Chain: ``drop_identifiers -> coerce_numeric -> add_difference -> fill_mode ->
fit_codebook/encode``. Two steps decide the next schema from the data
(which text columns become numeric; the codebook), so each runs one small
eager aggregate whose result has one row per column / per label. Everything
else is lazy Column arithmetic that Catalyst fuses into one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalis.functions.columns import col, text_columns
from vitalis.session import materialised

# Fixed values that must equal the studied application's behaviour.
IDENTIFIER_COLUMNS = ["SNO", "MRD No.", "D.O.A", "D.O.D", "month year", "Name", "ID", "Patient_ID"]
SYSTOLIC_PATTERNS = ["systolic", "sbp"]
DIASTOLIC_PATTERNS = ["diastolic", "dbp"]
LEAK_KEYWORDS = ["outcome", "death", "alive", "survived", "mortality", "target", "label", "event"]
DASHBOARD_TARGETS = ["HEART FAILURE", "ACS", "STEMI", "TARGET", "OUTPUT", "DEATH_EVENT", "Label", "Outcome", "DEATH"]
TRAINING_TARGETS = ["HEART FAILURE", "ACS", "STEMI", "TARGET", "OUTPUT", "DEATH_EVENT"]
DEFAULT_FEATURES = ["EF", "BNP", "HTN", "DM", "CAD", "CKD", "AGE", "HB", "UREA", "CREATININE", "GLUCOSE", "VALVULAR"]
NUMERIC_ACCEPT_BELOW = 0.9
NULL_LABEL = "nan"


# --- P1 / P7 -----------------------------------------------------------------
def drop_identifiers(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Drop identifier columns that are present (exact names)."""
    names = IDENTIFIER_COLUMNS if names is None else names
    return df.drop(*[n for n in names if n in df.columns])


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop user-selected columns."""
    return df.drop(*[c for c in cols if c in df.columns])


# --- P2 ----------------------------------------------------------------------
def numeric_acceptance(df: DataFrame, max_null: float = NUMERIC_ACCEPT_BELOW) -> DataFrame:
    """One row per text column: null share after numeric coercion and whether
    the column is accepted as numeric (share strictly below ``max_null``).
    One aggregate over all text columns — a single scan."""
    texts = text_columns(df)
    if not texts:
        spark = df.sparkSession
        return spark.createDataFrame([], "column string, null_share double, accepted boolean")
    row = df.agg(*[
        F.avg(F.when(col(c).try_cast("double").isNull(), 1.0).otherwise(0.0)).alias(f"_s{i}")
        for i, c in enumerate(texts)
    ])
    long = row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_s{i}").alias("null_share")) for i, c in enumerate(texts)
    ])).alias("r")).select("r.*")
    return long.withColumn("accepted", F.coalesce(F.col("null_share") < F.lit(max_null), F.lit(False)))


def coerce_numeric(df: DataFrame, max_null: float = NUMERIC_ACCEPT_BELOW) -> DataFrame:
    """Text columns whose coerced null share is < ``max_null`` become double
    (unparseable -> NULL); the others stay text."""
    accepted = {r["column"] for r in numeric_acceptance(df, max_null).where("accepted").collect()}
    return df.select(*[
        col(c).try_cast("double").alias(c) if c in accepted else col(c) for c in df.columns
    ])


# --- P3 ----------------------------------------------------------------------
def _first_matching(columns: list[str], patterns: list[str]) -> str | None:
    return next((c for c in columns if any(p in c.lower() for p in patterns)), None)


def add_difference(df: DataFrame, left_patterns: list[str] | None = None,
                   right_patterns: list[str] | None = None, out: str = "Pulse_Pressure") -> DataFrame:
    """``out = first(left) - first(right)`` where each is the first column
    whose lower-case name contains one of the patterns; both are coerced to
    double. Nothing happens unless both exist."""
    left = _first_matching(df.columns, left_patterns or SYSTOLIC_PATTERNS)
    right = _first_matching(df.columns, right_patterns or DIASTOLIC_PATTERNS)
    if left is None or right is None:
        return df
    df = df.withColumns({left: col(left).try_cast("double"), right: col(right).try_cast("double")})
    return df.withColumn(out, col(left) - col(right))


# --- P4 ----------------------------------------------------------------------
def column_modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Most frequent non-null value per column; ties go to the smallest value.

    Distributed: counts per (column, value) aggregate map-side, then a
    ``min_by`` over distinct values — never a per-column buffer of all rows."""
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, mode string")
    kv = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in cols
    ])).alias("kv")).select("kv.*").where(F.col("value").isNotNull())
    counts = kv.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("neg"), F.col("value").alias("v"))).alias("mode"))


def fill_mode(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Fill nulls of text columns with the column mode."""
    cols = [c for c in (cols if cols is not None else text_columns(df))]
    modes = {r["column"]: r["mode"] for r in column_modes(df, cols).collect()}  # one row per column
    return df.select(*[
        F.coalesce(col(c), F.lit(modes[c])).alias(c) if c in modes else col(c) for c in df.columns
    ])


# --- P5 / P6 -----------------------------------------------------------------
def fit_codebook(df: DataFrame, cols: list[str] | None = None, null_label: str | None = None) -> DataFrame:
    """P5: codebook ``(column string, label string, code int)``; code = rank of
    the label in sorted label order, from 0. With ``null_label`` (P6) a NULL is
    encoded as that text label instead of being ignored."""
    cols = cols if cols is not None else text_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, label string, code int")

    def lab(c: str) -> Column:
        v = col(c).cast("string")
        return F.coalesce(v, F.lit(null_label)) if null_label is not None else v

    kv = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), lab(c).alias("label")) for c in cols
    ])).alias("kv")).select("kv.*").where(F.col("label").isNotNull()).distinct()
    # ranks without one task per column: range partitions in label order, each with a local rank and an offset
    ranged = (kv.repartitionByRange("column", "label").withColumn("_part", F.spark_partition_id())
              .checkpoint(eager=True))
    local = Window.partitionBy("column", "_part").orderBy("label")
    before = Window.partitionBy("column").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy("column", "_part").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    book = (ranged.withColumn("_rank", F.row_number().over(local)).join(offsets, ["column", "_part"])
            .select("column", "label", (F.col("_before") + F.col("_rank") - 1).cast("int").alias("code")))
    # a table of known size: Spark broadcasts few labels, and the rows of a frequent label stay where they are
    return materialised(book, "codebook")


def code_of(df: DataFrame, book: DataFrame, cols: list[str], null_label: str | None = None,
            kind: str = "int") -> DataFrame:
    """``df`` with the text columns ``cols`` replaced by their codes (unseen label -> NULL, NULL -> the code of
    ``null_label``). One join per column on the label; Spark broadcasts a column's labels when they are few."""
    out = df
    for c in cols:
        v = col(c).cast("string")
        labels = book.where(F.col("column") == c).select(F.col("label").alias("_label"), F.col("code").alias("_code"))
        out = (out.withColumn("_own", F.coalesce(v, F.lit(null_label)) if null_label is not None else v)
               .join(labels, F.col("_own") == F.col("_label"), "left")
               .withColumn(c, F.col("_code").cast(kind)).drop("_own", "_label", "_code"))
    return out.select(*[col(c) for c in df.columns])


def encode(df: DataFrame, book: DataFrame, null_label: str | None = None, cols: list[str] | None = None) -> DataFrame:
    """Replace each codebook column (or ``cols``) by its code (unseen label -> NULL)."""
    if cols is None:  # one row per column
        cols = sorted(r["column"] for r in book.select("column").distinct().collect())
    return code_of(df, book, [c for c in cols if c in df.columns], null_label)


def clean(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The full cleaning chain P1 -> P2 -> P3 -> P4 -> P5; returns the encoded
    table and its codebook."""
    df = drop_identifiers(df)
    df = coerce_numeric(df)
    df = add_difference(df)
    texts = text_columns(df)
    df = fill_mode(df, texts)
    book = fit_codebook(df, texts)
    return encode(df, book, cols=texts), book


# --- P8 / P9 / P10 -----------------------------------------------------------
def guard_features(candidates: list[str], columns: list[str], cap: int = 12) -> list[str]:
    """Keep candidate names that exist and carry no leakage keyword."""
    keep = [c for c in candidates if c in columns and not any(k in c.lower() for k in LEAK_KEYWORDS)]
    return keep[:cap]


def suggest_features(df: DataFrame, target: str, k: int = 12) -> DataFrame:
    """Rank guarded numeric columns by |Pearson r| with the target."""
    from vitalis.operators.explore import target_correlation

    corr = target_correlation(df, target)
    allowed = guard_features([c for c in df.columns if c != target], df.columns, cap=len(df.columns))
    return (corr.where(F.col("column").isin(allowed) & F.col("corr").isNotNull())
            .withColumn("abs_corr", F.abs("corr"))
            .orderBy(F.desc("abs_corr"), "column").limit(k))


def resolve_target(columns: list[str], priority: list[str] | None = None) -> str | None:
    """P10: first priority name present (exact case), else the first column."""
    priority = DASHBOARD_TARGETS if priority is None else priority
    hit = next((t for t in priority if t in columns), None)
    return hit if hit is not None else (columns[0] if columns else None)


def resolve_features(columns: list[str], target: str, defaults: list[str] | None = None) -> list[str]:
    """P10: default features present in the table, else the first 10 non-target columns."""
    pool = [c for c in columns if c != target]
    feats = [f for f in (DEFAULT_FEATURES if defaults is None else defaults) if f in pool]
    return feats or pool[:10]
