"""Model comparison and promotion.

The run history and the package registry are small tables (one row per model
or per saved package); they are ordinary DataFrames, written as parquet
snapshots. Ranking uses a window over those few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalis.operators import evaluate as V

HISTORY_SCHEMA = ("run_id string, model string, accuracy double, recall double, precision double, f1 double, "
                  "f2 double, auc double, n_features int, threshold double, ts timestamp")
METRICS = ["accuracy", "recall", "precision", "f1", "f2", "auc"]
# fixed values: default custom ranking weights in percent (recall, precision, f1, accuracy)
DEFAULT_WEIGHTS = {"recall": 50, "precision": 30, "f1": 20, "accuracy": 0}


def clean_model_name(c):
    """Text before the first ``(``, trimmed."""
    return F.trim(F.split(c, r"\(").getItem(0))


def run_rows(scored: DataFrame, run_label: str, n_features: int, by: str = "model",
             threshold: float | None = None) -> DataFrame:
    """Run-history rows from a scored table: V1 metrics + AUC per model."""
    met = V.metrics(scored, by=[by], threshold=threshold)
    a = V.auc(scored, by=[by])
    ts = scored.groupBy(by).agg(F.max("ts").alias("ts"))
    j = met.join(a, by).join(ts, by)
    return j.select(
        F.concat(F.col(by), F.lit(f" ({run_label}) - "), F.date_format("ts", "HH:mm:ss")).alias("run_id"),
        F.col(by).alias("model"), *[F.col(m) for m in METRICS],
        F.lit(n_features).cast("int").alias("n_features"),
        F.lit(threshold).cast("double").alias("threshold"), "ts")


# --- G1 ----------------------------------------------------------------------
def upsert_run(history: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per clean model name; the newest run wins."""
    allr = history.unionByName(runs).withColumn("model", clean_model_name(F.col("model")))
    w = Window.partitionBy("model").orderBy(F.desc("ts"), F.desc("run_id"))
    return allr.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


# --- G2 ----------------------------------------------------------------------
def delete_run(history: DataFrame, model: str) -> DataFrame:
    return history.where(F.col("model") != F.lit(model))


# --- G3 ----------------------------------------------------------------------
def retune_run(history: DataFrame, model: str, metrics_row: DataFrame, threshold: float) -> DataFrame:
    """Replace a model's history metrics by those at a new threshold and store
    the threshold (packages keep their training-time metrics)."""
    m = metrics_row.select(*[F.col(c).alias(f"_n_{c}") for c in METRICS if c in metrics_row.columns]) \
        .withColumn("_model", F.lit(model))
    j = history.join(F.broadcast(m), history["model"] == m["_model"], "left")  # one-row side
    hit = F.col("_model").isNotNull()
    return j.select("run_id", "model", *[
        F.when(hit & F.col(f"_n_{c}").isNotNull(), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)
        if c in metrics_row.columns else F.col(c) for c in METRICS],
        "n_features", F.when(hit, F.lit(threshold)).otherwise(F.col("threshold")).alias("threshold"), "ts")


# --- G4 ----------------------------------------------------------------------
def score_column(weights: dict | None):
    """F2, or the weighted sum when the weights total 100 (missing metric 0)."""
    if weights is None or sum(weights.values()) != 100:
        return F.coalesce(F.col("f2"), F.lit(0.0))
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.coalesce(F.col(name), F.lit(0.0)) * F.lit(w / 100.0)
    return total


def leaderboard(history: DataFrame, weights: dict | None = None, order_col: str = "ts") -> DataFrame:
    """Rank by score descending; ties keep insertion order."""
    w = Window.orderBy(F.desc("score"), F.col(order_col).asc())  # one row per model
    return (history.withColumn("score", score_column(weights))
            .withColumn("rank", F.row_number().over(w).cast("int")))


# --- G5 ----------------------------------------------------------------------
RADAR_METRICS = ["accuracy", "recall", "precision", "f1", "f2"]


def radar(history: DataFrame, weights: dict | None = None, top: int = 3) -> DataFrame:
    lb = leaderboard(history, weights).where(F.col("rank") <= top)
    return lb.select("rank", "model", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m), F.lit(0.0)).alias("value")) for m in RADAR_METRICS
    ])).alias("r")).select("rank", "model", "r.metric", "r.value")


# --- G6 ----------------------------------------------------------------------
def candidate_vs_active(registry: DataFrame, active: DataFrame | None, weights: dict | None = None,
                        name: str | None = None) -> DataFrame:
    """The top-ranked package (or the named one) with per-metric deltas versus
    the active package (NULL when nothing is active)."""
    lb = leaderboard(registry, weights, order_col="saved_at")
    cand = lb.where(F.col("package") == F.lit(name)) if name else lb.where("rank = 1")
    cand = cand.select("package", "model", "rank", "score", *METRICS).withColumn("_k", F.lit(0))
    if active is None:
        act = cand.sparkSession.createDataFrame([(0,)], "_k int").select(
            "_k", *[F.lit(None).cast("double").alias(f"_a_{m}") for m in METRICS])
    else:
        act = active.select(F.lit(0).alias("_k"), *[F.col(m).alias(f"_a_{m}") for m in METRICS])
    j = cand.join(F.broadcast(act), "_k", "left")  # single-row side
    return j.select("package", "model", "rank", "score", *METRICS,
                    *[(F.col(m) - F.col(f"_a_{m}")).alias(f"delta_{m}") for m in METRICS])


# --- G8 ----------------------------------------------------------------------
def reevaluate(scores: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """Metrics of a stored package recomputed from its saved test scores at
    prob >= 0.5 (all metrics properly computed)."""
    met = V.metrics(scores, label=label, threshold=0.5, prob=prob).withColumn("_k", F.lit(0))
    a = V.auc(scores, label=label, prob=prob).withColumn("_k", F.lit(0))
    return met.join(a, "_k").drop("_k")
