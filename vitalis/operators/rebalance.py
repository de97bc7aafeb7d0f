"""Rebalancing of a binary training table.

All samplers share one plan: pick seed rows of the minority class with a
per-row quota, find their ``k`` nearest minority neighbours with the exact
grid k-NN join, expand each seed to ``quota`` copies (``sequence`` +
``explode``), choose a neighbour and a gap from md5 fractions of
``(key, seed, copy)``, and interpolate ``a + gap * (b - a)``. Randomness
depends only on row identity, so the result is identical on every run and
independent of partitioning (the library's own random stream cannot be
reproduced; distribution and contract are the same).

Run on unscaled training rows, after the split (the studied workflow's order).
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalis.functions.columns import col
from vitalis.functions.ranking import hash_rank
from vitalis.functions.rng import unit_hash
from vitalis.operators.neighbours import knn_join


class SamplerError(ValueError):
    pass


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per label value (two rows for a binary label)."""
    return {r[0]: r[1] for r in df.groupBy(col(label)).count().collect()}


def _minority_majority(df: DataFrame, label: str):
    counts = class_counts(df, label)
    if len(counts) != 2:
        raise SamplerError(f"rebalancing needs exactly two classes, found {sorted(counts)}")
    (mi, n_mi), (ma, n_ma) = sorted(counts.items(), key=lambda kv: (kv[1], kv[0]))
    return mi, n_mi, ma, n_ma


def _quota_by_rank(seeds: DataFrame, key: str, n_new: int, n_seeds: int, seed: int) -> DataFrame:
    """Spread ``n_new`` copies over ``n_seeds`` rows: ``n_new // n_seeds`` each,
    one more for the ``n_new % n_seeds`` rows with the smallest md5 fraction."""
    base, extra = divmod(n_new, n_seeds)
    u = seeds.withColumn("_qu", unit_hash(col(key), seed, "quota"))
    ranked = hash_rank(u, [], "_qu", "_qr")
    return ranked.withColumn("quota", (F.lit(base) + F.when(F.col("_qr") <= extra, 1).otherwise(0)).cast("int")
                             ).drop("_qu", "_qr")


def _interpolate(seeds: DataFrame, minority: DataFrame, key: str, features: list[str], label: str,
                 label_value, k: int, seed: int) -> DataFrame:
    """Synthetic rows for seeds with a ``quota`` column."""
    nn = knn_join(seeds.select(*map(col, [key, *features])), minority.select(*map(col, [key, *features])), qkey=key, pkey=key,
                  features=features, k=k, exclude_self=True)
    navail = nn.groupBy("query_key").agg(F.count(F.lit(1)).alias("_na"))
    copies = (seeds.where(F.col("quota") > 0)
              .join(navail, col(key) == F.col("query_key"), "inner").drop("query_key")
              .select(col(key).alias("_a"), *[col(f).alias(f"_a_{i}") for i, f in enumerate(features)], "_na",
                      F.explode(F.sequence(F.lit(0), F.col("quota") - 1)).alias("_copy")))
    copies = copies.withColumn("rank", (F.floor(unit_hash(F.col("_a"), seed, F.concat(F.lit("nb|"), F.col("_copy").cast("string")))
                                                 * F.col("_na")) + 1).cast("int"))
    copies = copies.withColumn("_gap", unit_hash(F.col("_a"), seed, F.concat(F.lit("gap|"), F.col("_copy").cast("string"))))
    nb = nn.join(minority.select(col(key).alias("point_key"), *[col(f).alias(f"_b_{i}") for i, f in enumerate(features)]),
                 on="point_key", how="inner").select(F.col("query_key").alias("_a"), "rank",
                                                      *[f"_b_{i}" for i in range(len(features))])
    j = copies.join(nb, on=["_a", "rank"], how="inner")
    return j.select(
        F.concat(F.col("_a").cast("string"), F.lit("#"), F.col("_copy").cast("string")).alias(key),
        *[(F.col(f"_a_{i}") + F.col("_gap") * (F.col(f"_b_{i}") - F.col(f"_a_{i}"))).alias(f)
          for i, f in enumerate(features)],
        F.lit(label_value).alias(label),
    )


def _with_string_key(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn(key, col(key).cast("string"))


# --- T2 ----------------------------------------------------------------------
def smote_samples(df: DataFrame, key: str, features: list[str], label: str, k: int = 5,
                  seed: int = 42) -> DataFrame:
    """Synthetic minority rows only (``key`` becomes ``"<seed key>#<copy>"``)."""
    mi, n_mi, ma, n_ma = _minority_majority(df, label)
    n_new = n_ma - n_mi
    base = _with_string_key(df.select(*map(col, [key, *features, label])), key)
    minority = base.where(col(label) == F.lit(mi))
    if n_new <= 0:
        return base.limit(0)
    if n_mi < 2:
        raise SamplerError("SMOTE needs at least two minority rows")
    seeds = _quota_by_rank(minority, key, n_new, n_mi, seed)
    return _interpolate(seeds, minority, key, features, label, mi, k, seed)


def smote(df: DataFrame, key: str, features: list[str], label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Raise the minority class to the majority count."""
    base = _with_string_key(df.select(*map(col, [key, *features, label])), key)
    return base.unionByName(smote_samples(df, key, features, label, k, seed))


# --- T3 ----------------------------------------------------------------------
def adasyn_samples(df: DataFrame, key: str, features: list[str], label: str, k: int = 5,
                   seed: int = 42) -> DataFrame:
    """ADASYN: each minority row's share of new rows is proportional to the
    share of majority rows among its ``k`` nearest neighbours (whole table);
    quotas ``rint(ratio / sum * G)`` (half to even)."""
    mi, n_mi, ma, n_ma = _minority_majority(df, label)
    g = n_ma - n_mi
    base = _with_string_key(df.select(*map(col, [key, *features, label])), key)
    minority = base.where(col(label) == F.lit(mi))
    nn = knn_join(minority, base, qkey=key, pkey=key, features=features, k=k, exclude_self=True, carry=[label])
    ratio = nn.groupBy("query_key").agg((F.count_if(col(label) != F.lit(mi)) / F.lit(float(k))).alias("_r"))
    total = ratio.agg(F.sum("_r")).first()[0] or 0.0  # one number
    if total <= 0:
        raise SamplerError("no minority row has a majority neighbour")
    seeds = (minority.join(ratio, minority[key] == ratio["query_key"], "inner").drop("query_key")
             .withColumn("quota", F.bround(F.col("_r") / F.lit(total) * F.lit(float(g)), 0).cast("int")).drop("_r"))
    return _interpolate(seeds, minority, key, features, label, mi, k, seed)


def adasyn(df: DataFrame, key: str, features: list[str], label: str, k: int = 5, seed: int = 42) -> DataFrame:
    base = _with_string_key(df.select(*map(col, [key, *features, label])), key)
    return base.unionByName(adasyn_samples(df, key, features, label, k, seed))


# --- T4 ----------------------------------------------------------------------
def danger_set(df: DataFrame, key: str, features: list[str], label: str, m: int = 10) -> DataFrame:
    """Minority rows with at least half, but not all, of their ``m`` nearest
    neighbours (whole table) in the majority class."""
    mi, _, _, _ = _minority_majority(df, label)
    base = _with_string_key(df.select(*map(col, [key, *features, label])), key)
    minority = base.where(col(label) == F.lit(mi))
    nn = knn_join(minority, base, qkey=key, pkey=key, features=features, k=m, exclude_self=True, carry=[label])
    maj = nn.groupBy("query_key").agg(F.count_if(col(label) != F.lit(mi)).alias("_maj"))
    danger = maj.where((F.col("_maj") * 2 >= m) & (F.col("_maj") < m)).select(F.col("query_key").alias(key))
    return minority.join(danger, on=key, how="left_semi")


def borderline_smote_samples(df: DataFrame, key: str, features: list[str], label: str, k: int = 5,
                             m: int = 10, seed: int = 42) -> DataFrame:
    """Borderline-SMOTE (variant 1): SMOTE seeded from the danger set only,
    neighbours among all minority rows."""
    mi, n_mi, ma, n_ma = _minority_majority(df, label)
    n_new = n_ma - n_mi
    base = _with_string_key(df.select(*map(col, [key, *features, label])), key)
    minority = base.where(col(label) == F.lit(mi))
    danger = danger_set(df, key, features, label, m).cache()
    n_d = danger.count()
    if n_d == 0:
        raise SamplerError("empty danger set")
    seeds = _quota_by_rank(danger, key, n_new, n_d, seed)
    return _interpolate(seeds, minority, key, features, label, mi, k, seed)


def borderline_smote(df: DataFrame, key: str, features: list[str], label: str, k: int = 5, m: int = 10,
                     seed: int = 42) -> DataFrame:
    base = _with_string_key(df.select(*map(col, [key, *features, label])), key)
    return base.unionByName(borderline_smote_samples(df, key, features, label, k, m, seed))


# --- T5 ----------------------------------------------------------------------
SAMPLERS = {"smote": smote, "adasyn": adasyn, "borderline": borderline_smote}


def rebalance(df: DataFrame, method: str, key: str, features: list[str], label: str, seed: int = 42) -> DataFrame:
    """Apply a sampler by name; ``none`` passes through; a failing ADASYN or
    Borderline-SMOTE falls back to SMOTE with a warning."""
    if method in (None, "none"):
        return df
    fn = SAMPLERS[method]
    try:
        return fn(df, key, features, label, seed=seed)
    except SamplerError as ex:
        if method == "smote":
            raise
        warnings.warn(f"{method} failed ({ex}); using SMOTE instead", stacklevel=2)
        return smote(df, key, features, label, seed=seed)
