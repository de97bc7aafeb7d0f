"""Shapley attribution of the class-1 probability (S10), as a batch job.

For each row and each coalition S of features, the row's values are kept for
the features in S and replaced by the background (the stored medians) for the
rest; one model ``transform`` scores every hybrid row, and one grouped sum per
row and feature weighs the probabilities. The weights are a small table,
coalition -> one number per feature, the same for all rows:

* ``method="exact"``: all 2^F coalitions; feature i has ``w(|S|-1)`` if i in S
  else ``-w(|S|)``, ``w(s) = s!(F-s-1)!/F!``;
* ``method="sampled"``: ``n_perm`` permutations of the features, drawn by md5 of
  (seed, permutation, feature); each contributes ``v(prefix_j) - v(prefix_{j-1})`` to
  its j-th feature. Coalitions that several permutations pass are scored once.

``base`` is the probability of the background (the empty coalition). The studied
system's noisy five-row background is replaced by the single median row (its noise is
unseeded), so ``sum(phi) = p - base`` holds exactly. Forests are explained by
their trees: ``operators.tree_shapley``.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalis.functions.columns import as_double, col


def _weight(s: int, f: int) -> float:
    return math.factorial(s) * math.factorial(f - s - 1) / math.factorial(f)


def coalition_weights(features: list[str], method: str = "exact", n_perm: int = 32, seed: int = 42) -> dict[int, list[float]]:
    """Bit mask of a coalition -> its weight for each feature."""
    nf = len(features)
    if method == "exact":
        return {m: [_weight(m.bit_count() - 1, nf) if m >> i & 1 else -_weight(m.bit_count(), nf) for i in range(nf)]
                for m in range(1 << nf)}
    out = {0: [0.0] * nf}
    for perm in range(n_perm):
        mask = 0
        for i in sorted(range(nf), key=lambda i: hashlib.md5(f"{seed}|{perm}|{features[i]}".encode()).hexdigest()):
            out[mask][i] -= 1.0 / n_perm
            mask |= 1 << i
            out.setdefault(mask, [0.0] * nf)[i] += 1.0 / n_perm
    return out


def shapley(df: DataFrame, key: str, features: list[str], medians: dict[str, float], prob_fn,
            method: str = "exact", n_perm: int = 32, seed: int = 42) -> DataFrame:
    """``(key, feature, contribution, base)`` for every row and feature; the key must be unique.

    ``prob_fn(hybrid_df) -> hybrid_df + prob`` scores a DataFrame holding the
    feature columns (and any other columns, which it must keep)."""
    if method not in ("exact", "sampled"):
        raise ValueError("method must be 'exact' or 'sampled'")
    nf = len(features)
    bg = {f: float(medians.get(f) or 0.0) for f in features}
    weights = coalition_weights(features, method, n_perm, seed)
    coalitions = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.array(*map(F.lit, w)).alias("w"))
                           for m, w in sorted(weights.items())])
    rows = df.select(col(key), *[as_double(f).alias(f) for f in features], F.explode(coalitions).alias("_c"))
    hybrid = rows.select(col(key), F.col("_c.mask").alias("_mask"), F.col("_c.w").alias("_w"), *[
        F.when(F.col("_c.mask").bitwiseAND(F.lit(1 << i)) != 0, col(f)).otherwise(F.lit(bg[f])).alias(f)
        for i, f in enumerate(features)])
    summed = prob_fn(hybrid).groupBy(col(key)).agg(
        F.max(F.when(F.col("_mask") == 0, F.col("prob"))).alias("base"),
        *[F.sum(F.col("_w")[i] * F.col("prob")).alias(f"_phi{i}") for i in range(nf)])
    return summed.select(col(key), "base", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"_phi{i}").alias("contribution")) for i, f in enumerate(features)
    ])).alias("_r")).select(col(key), "_r.feature", "_r.contribution", "base")


def linear_prob_fn(features: list[str], scaler: dict, linear: dict):
    from vitalis.operators.score import linear_probability

    def fn(df: DataFrame) -> DataFrame:
        return df.withColumn("prob", linear_probability(features, scaler, linear))
    return fn
