"""Batch scoring on a stored package.

Scoring is one narrow plan: project the package features, encode text with
the codebook (a literal map of checked size), record missing features, fill
medians, scale and predict. A logistic package is evaluated as a Column
expression (``1 / (1 + exp(-z))``) — whole-stage codegen, no vector assembly
and no Python; other models go through their ``PipelineModel``. Nothing here
shuffles, so the same function also runs on a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalis.functions.columns import as_double, col
from vitalis.operators.clean import code_of
from vitalis.sources.tables import require_columns

# fixed values
ID_COLUMN_NAMES = ["id", "patient_id", "name", "ten"]
VERDICT_CUT = 50.0          # positive iff risk > 50
URGENT_CUT = 80.0           # action: > 80 urgent, > 50 monitor, else maintain
GAUGE_BANDS = [50.0, 75.0]  # gauge steps 0-50 / 50-75 / 75-100
DIFF_CUT = 10.0             # |diff %| above which a value is high / low
TOP_FEATURES = 10


# --- S1 / S2 -------------------------------------------------------------------
def select_features(df: DataFrame, key: str, features: list[str], extra: list[str] | None = None) -> DataFrame:
    """The key, any display columns and the package features (checked)."""
    require_columns(df, features)
    extra = [c for c in (extra or []) if c in df.columns and c not in features and c != key]
    return df.select(col(key), *[col(c) for c in extra], *[col(f) for f in features])


def encode_for_scoring(df: DataFrame, features: list[str], book: DataFrame | None,
                       null_label: str | None = None) -> DataFrame:
    """Text features -> codebook code (unseen label -> NULL; NULL -> the code of
    the label that stood for it when the codebook was fitted) when the column has a
    codebook, else numeric coercion; numeric features as double."""
    types = {f.name: f.dataType for f in df.schema.fields}
    texts = [c for c in features if isinstance(types[c], T.StringType)]
    coded = sorted(r["column"] for r in book.select("column").distinct().collect()) if book is not None and texts else []
    coded = [c for c in texts if c in coded]

    def enc(c: str) -> Column:
        if c not in features or c in coded:
            return col(c)
        return (col(c).try_cast("double") if c in texts else as_double(c)).alias(c)

    return code_of(df.select(*[enc(c) for c in df.columns]), book, coded, null_label, "double")


# --- S3 ----------------------------------------------------------------------
def missing_columns(features: list[str]) -> Column:
    """S3: names of the features that are NULL in this row (before filling)."""
    return F.filter(F.array(*[F.when(col(f).isNull(), F.lit(f)) for f in features]), lambda x: x.isNotNull())


# --- S4 / S5 -------------------------------------------------------------------
def linear_probability(features: list[str], scaler: dict, linear: dict) -> Column:
    """Logistic model as a Column: scaled features, fixed coefficients."""
    z = F.lit(float(linear["intercept"]))
    for f in features:
        mean, scale = scaler.get(f, (0.0, 1.0))
        z = z + F.lit(float(linear["coefficients"][f])) * ((col(f) - F.lit(float(mean))) / F.lit(float(scale)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def linear_from_model(model, features: list[str]) -> dict | None:
    """Coefficients of a fitted logistic ``PipelineModel`` (assembler + LR)."""
    stages = getattr(model, "stages", [])
    if len(stages) == 2 and stages[1].__class__.__name__ == "LogisticRegressionModel":
        lr = stages[1]
        return {"intercept": float(lr.intercept),
                "coefficients": dict(zip(features, [float(v) for v in lr.coefficients.toArray()]))}
    return None


def score(df: DataFrame, pkg, key: str, extra: list[str] | None = None, fallback: bool = False) -> DataFrame:
    """``key, extra..., features (filled), missing_cols, prob, prediction,
    risk_pct``. ``fallback`` scores a model without probabilities as 100/0."""
    from vitalis.operators.missing import fill_medians
    from vitalis.operators.models import predict

    feats = pkg.features
    x = encode_for_scoring(select_features(df, key, feats, extra), feats, pkg.codebook, pkg.null_label)
    x = x.withColumn("missing_cols", missing_columns(feats))
    x = fill_medians(x, feats, pkg.medians)
    linear = pkg.linear or linear_from_model(pkg.model, feats)
    if linear is not None:
        p = linear_probability(feats, pkg.scaler, linear)
        out = x.withColumn("prob", p).withColumn("prediction", F.when(F.col("prob") > 0.5, 1.0).otherwise(0.0))
    else:
        keep = [c for c in x.columns if c not in feats]
        scaled = x.select(*[col(c) for c in keep], *[col(f).alias(f"_orig_{i}") for i, f in enumerate(feats)], *[
            ((col(f) - F.lit(float(pkg.scaler.get(f, (0.0, 1.0))[0]))) / F.lit(float(pkg.scaler.get(f, (0.0, 1.0))[1]))).alias(f)
            for f in feats])
        pred = predict(pkg.model, scaled, feats, key)
        out = pred.select(*[col(c) for c in keep], *[F.col(f"_orig_{i}").alias(f) for i, f in enumerate(feats)],
                          "prob", "prediction")
    if fallback:
        out = out.withColumn("prob", F.col("prediction"))
    return out.withColumn("risk_pct", F.bround(F.col("prob") * 100.0, 2))


# --- S6 ----------------------------------------------------------------------
def patient_label(df: DataFrame, key: str) -> DataFrame:
    """``<id> - Risk: <risk>%`` (+ a warning when features were missing);
    the id is the first column named id / patient_id / name / ten (any case),
    else ``Record <key>``."""
    idc = next((c for c in df.columns if c.lower() in ID_COLUMN_NAMES), None)
    ident = col(idc).cast("string") if idc else F.concat(F.lit("Record "), col(key).cast("string"))
    warn = F.when(F.size("missing_cols") > 0, F.lit(" (missing/invalid values)")).otherwise(F.lit(""))
    return df.withColumn("label_view", F.concat(ident, F.lit(" - Risk: "), F.col("risk_pct").cast("string"),
                                                F.lit("%"), warn))


# --- S7 ----------------------------------------------------------------------
def verdict(df: DataFrame) -> DataFrame:
    """Verdict, confidence, recommended action and gauge band."""
    r = F.col("risk_pct")
    return df.select(
        "*",
        F.when(r > VERDICT_CUT, F.lit("positive")).otherwise(F.lit("negative")).alias("verdict"),
        (F.greatest(F.col("prob"), F.lit(1.0) - F.col("prob")) * 100.0).alias("confidence"),
        F.when(r > URGENT_CUT, F.lit("urgent")).when(r > VERDICT_CUT, F.lit("monitor"))
        .otherwise(F.lit("maintain")).alias("action"),
        F.when(r > GAUGE_BANDS[1], F.lit("75-100")).when(r > GAUGE_BANDS[0], F.lit("50-75"))
        .otherwise(F.lit("0-50")).alias("band"),
    )


# --- S8 ----------------------------------------------------------------------
def patient(df: DataFrame, label_view: str) -> DataFrame:
    """The record selected by its display label."""
    return df.where(F.col("label_view") == F.lit(label_view))


# --- S9 ----------------------------------------------------------------------
def compare_to_typical(df: DataFrame, key: str, importance: dict[str, float], medians: dict[str, float],
                       top: int = TOP_FEATURES) -> DataFrame:
    """For the ``top`` most important features: value, typical (median, 0
    if absent), diff % = (v - m) / m * 100, and high / low (|diff| > 10 %,
    rounded percent) / normal / N/A (median 0 or absent)."""
    ranked = sorted(importance.items(), key=lambda kv: (-kv[1], kv[0]))[:top]
    feats = [f for f, _ in ranked if f in df.columns]
    rows = df.select(col(key), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(float(importance[f])).alias("importance"),
                 as_double(f).alias("value"), F.lit(float(medians.get(f) or 0.0)).alias("typical"))
        for f in feats])).alias("c")).select(col(key), "c.*")
    diff = F.when(F.col("typical") != 0, (F.col("value") - F.col("typical")) / F.col("typical") * 100.0)
    pct = F.bround(F.abs(F.col("diff_pct")), 0).cast("long").cast("string")
    return rows.withColumn("diff_pct", diff).withColumn(
        "assessment",
        F.when(F.col("diff_pct").isNull(), F.lit("N/A"))
        .when(F.abs(F.col("diff_pct")) > DIFF_CUT,
              F.concat(F.when(F.col("diff_pct") > 0, F.lit("high (")).otherwise(F.lit("low (")), pct, F.lit("%)")))
        .otherwise(F.lit("normal")))
