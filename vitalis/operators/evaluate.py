"""Evaluation of a scored table ``(label, prob[, prediction])`` (V1-V7).

All threshold-based outputs come from ONE aggregate: each row falls into the
bucket "number of thresholds <= prob" (a balanced comparison tree, codegen'd),
counts are summed per bucket (at most len(thresholds)+1 rows per group) and the
per-threshold confusion counts are suffix sums over that tiny table. Rank-based
outputs (AUC, ROC) use the bucketed prefix sums of ``functions.ranking`` over
distinct scores, so no single task ever holds all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalis.functions.columns import col
from vitalis.functions.ranking import prefix_sums


def _safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    prec = _safe_div(tp, tp + fp)
    rec = _safe_div(tp, tp + fn)
    f1 = _safe_div(2 * tp, 2 * tp + fp + fn)
    f2 = _safe_div(5 * tp, 5 * tp + 4 * fn + fp)
    return [
        _safe_div(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        rec.alias("recall"), prec.alias("precision"),
        _safe_div(tn, tn + fp).alias("specificity"),
        f1.alias("f1"), f2.alias("f2"),
    ]


def default_thresholds() -> list[float]:
    """0.00, 0.01, ..., 1.00 as i/100 (slider values)."""
    return [i / 100.0 for i in range(101)]


def decision_thresholds(n: int = 100, lo: float = 0.01, hi: float = 0.99) -> list[float]:
    """``linspace(lo, hi, n)``: lo + i*step, the last one exactly ``hi``."""
    step = (hi - lo) / (n - 1)
    return [lo + i * step for i in range(n - 1)] + [hi]


# --- V1 ----------------------------------------------------------------------
def confusion_counts(df: DataFrame, label: str = "label", pred: Column | None = None,
                     by: list[str] | None = None) -> DataFrame:
    by = by or []
    p = pred if pred is not None else col("prediction")
    y = col(label)
    return df.groupBy(*[col(b) for b in by]).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))


def metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
            by: list[str] | None = None, threshold: float | None = None, prob: str = "prob") -> DataFrame:
    """V1: accuracy, recall, precision, specificity, F1, F2 (0 when undefined).
    Uses the model's own ``prediction`` unless a ``threshold`` on ``prob`` is given."""
    pred = (F.when(col(prob) >= F.lit(threshold), 1).otherwise(0) if threshold is not None else col(prediction))
    c = confusion_counts(df, label, pred, by)
    return c.select(*[col(b) for b in (by or [])], "tp", "fp", "fn", "tn",
                    *_rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


# --- V2 ----------------------------------------------------------------------
def _score_groups(df: DataFrame, label: str, prob: str, by: list[str]) -> DataFrame:
    """Distinct scores with their class counts. The bucketed prefix pass reads
    this table three times (bounds, bucket totals, local prefix); it is written
    once to the shared checkpoint folder so the scored input (often a model
    transform) runs once."""
    g = (df.where(col(prob).isNotNull() & col(label).isNotNull())
         .groupBy(*[col(b) for b in by], col(prob).cast("double").alias("score"))
         .agg(F.count_if(col(label) == 1).alias("pos"), F.count_if(col(label) != 1).alias("neg")))
    return g.checkpoint(eager=True)


def auc(df: DataFrame, label: str = "label", prob: str = "prob", by: list[str] | None = None) -> DataFrame:
    """V2: tie-aware area under the ROC curve (Mann-Whitney form); 0 when only
    one class is present."""
    by = by or []
    g = prefix_sums(_score_groups(df, label, prob, by), by, "score", ["neg"])
    a = g.groupBy(*[col(b) for b in by]).agg(
        F.sum(F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg"))).alias("_u"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return a.select(*[col(b) for b in by], F.when((F.col("_p") == 0) | (F.col("_n") == 0), F.lit(0.0))
                    .otherwise(F.col("_u") / (F.col("_p") * F.col("_n"))).alias("auc"))


# --- V3 / V7 shared -------------------------------------------------------------
def _count_le(v: Column, ts: list[float]) -> Column:
    """Number of thresholds ``<= v`` (ts sorted): balanced comparison tree."""

    def build(lo: int, hi: int) -> Column:
        if lo >= hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v >= F.lit(ts[mid]), build(mid + 1, hi)).otherwise(build(lo, mid))

    return build(0, len(ts))


def counts_at_thresholds(df: DataFrame, thresholds: list[float], label: str = "label",
                         prob: str = "prob", by: list[str] | None = None) -> DataFrame:
    """``(by..., i, threshold, tp, fp, fn, tn)`` for every threshold, class 1 iff
    prob >= threshold. One pass over the rows."""
    by = by or []
    ts = sorted(thresholds)
    gcols = [col(b) for b in by]
    base = df.where(col(prob).isNotNull())
    per_bucket = base.groupBy(*gcols, _count_le(col(prob).cast("double"), ts).alias("_b")).agg(
        F.count_if(col(label) == 1).alias("pos"), F.count_if(col(label) != 1).alias("neg"))
    totals = per_bucket.groupBy(*gcols).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    # bucket b counts as predicted-positive for thresholds 0..b-1: at most len(ts)^2 small rows
    contrib = per_bucket.select(*gcols, "pos", "neg",
                                F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("i")).where(F.col("_b") > 0)
    summed = contrib.groupBy(*gcols, "i").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    grid = totals.select(*gcols, "P", "N", F.posexplode(F.array(*[F.lit(float(t)) for t in ts])).alias("i", "threshold"))
    j = grid.join(summed, on=[*by, "i"], how="left")
    tp = F.coalesce(F.col("tp"), F.lit(0)).cast("long")
    fp = F.coalesce(F.col("fp"), F.lit(0)).cast("long")
    return j.select(*gcols, F.col("i").cast("int").alias("i"), "threshold", tp.alias("tp"), fp.alias("fp"),
                    (F.col("P") - tp).alias("fn"), (F.col("N") - fp).alias("tn"))


def threshold_metrics(df: DataFrame, thresholds: list[float] | None = None, label: str = "label",
                      prob: str = "prob", by: list[str] | None = None) -> DataFrame:
    """V3: confusion counts and rates for each threshold (default 0..1 step 0.01)."""
    c = counts_at_thresholds(df, thresholds or default_thresholds(), label, prob, by)
    return c.select(*[col(b) for b in (by or [])], "threshold", "tp", "fp", "fn", "tn",
                    *_rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


# --- V4 ----------------------------------------------------------------------
def confusion(df: DataFrame, threshold: float = 0.5, label: str = "label", prob: str = "prob") -> DataFrame:
    """V4: the 2x2 matrix as rows ``(actual, predicted, count)``, zeros kept."""
    pred = F.when(col(prob) >= F.lit(threshold), 1).otherwise(0)
    c = confusion_counts(df, label, pred)
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    return c.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(n).alias("count")) for a, p, n in cells
    ])).alias("c")).select("c.*")


# --- V5 ----------------------------------------------------------------------
def roc_curve(df: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """V5: ``(score, fpr, tpr)`` for every distinct score (descending sweep),
    plus the origin with a NULL score. All points kept (a superset of the
    library's reduced curve)."""
    g = prefix_sums(_score_groups(df, label, prob, []), [], "score", ["pos", "neg"], descending=True)
    tot = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).withColumn("_k", F.lit(0))
    # one-row totals, joined on a constant key (broadcast of a single row)
    j = g.withColumn("_k", F.lit(0)).join(F.broadcast(tot), on="_k", how="inner")
    pts = j.select("score", _safe_div(F.col("neg_before") + F.col("neg"), F.col("N")).alias("fpr"),
                   _safe_div(F.col("pos_before") + F.col("pos"), F.col("P")).alias("tpr"))
    origin = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("score"),
                                             F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(pts)


# --- V6 ----------------------------------------------------------------------
def calibration(df: DataFrame, bins: int = 10, label: str = "label", prob: str = "prob") -> DataFrame:
    """V6: uniform bins of [0, 1] (edges ``j * (1/bins)``); a score on an inner
    edge goes to the lower bin; only non-empty bins."""
    step = 1.0 / bins
    edges = [j * step for j in range(1, bins)]
    v = col(prob).cast("double")

    def count_lt(lo: int, hi: int) -> Column:
        if lo >= hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v > F.lit(edges[mid]), count_lt(mid + 1, hi)).otherwise(count_lt(lo, mid))

    return (df.where(v.isNotNull()).groupBy(count_lt(0, len(edges)).cast("int").alias("bin"))
            .agg(F.avg(v).alias("mean_prob"), F.avg((col(label) == 1).cast("double")).alias("positive_share"),
                 F.count(F.lit(1)).alias("n")))


# --- V7 ----------------------------------------------------------------------
def decision_curve(df: DataFrame, thresholds: list[float] | None = None, label: str = "label",
                   prob: str = "prob") -> DataFrame:
    """V7: net benefit of the model, treat-all and treat-none per threshold."""
    c = counts_at_thresholds(df, thresholds or decision_thresholds(), label, prob)
    n = (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).cast("double")
    t = F.col("threshold")
    odds = t / (F.lit(1.0) - t)
    prev = (F.col("tp") + F.col("fn")) / n
    return c.select("threshold",
                    (F.col("tp") / n - F.col("fp") / n * odds).alias("net_benefit"),
                    (prev - (F.lit(1.0) - prev) * odds).alias("treat_all"),
                    F.lit(0.0).alias("treat_none"))
