"""Split and scale."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalis.functions.columns import as_double, col
from vitalis.functions.ranking import hash_rank, rank_cuts
from vitalis.functions.rng import unit_hash
from vitalis.session import materialised


def _labelled(df: DataFrame, label: str) -> DataFrame:
    """``df``; a row without a label ends the job with a clear error instead of getting lost."""
    message = F.raise_error(F.lit(f"the label column {label!r} holds NULL: drop or fill those rows before a split"))
    return df.withColumn(label, F.coalesce(col(label), message.cast(df.schema[label].dataType)))


# --- T1 ----------------------------------------------------------------------
MOST_LABELS = 100  # whose ranks are cut by comparing
U = "_split_u"


def split_flags(df: DataFrame, key: str, label: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: inside each label, the ``round(test * n_label)`` rows
    with the smallest md5 fraction of the key. Exact per-class shares; no row is
    ranked: the fraction where a label's share ends is found, then rows are compared with it."""
    return _flagged(_with_fraction(df, key, label, test, seed), key, label, test)


def _with_fraction(df: DataFrame, key: str, label: str, test: float, seed: int) -> DataFrame:
    if not 0.0 < test < 1.0:
        raise ValueError("test share must be in (0, 1)")
    return _labelled(df, label).withColumn(U, unit_hash(col(key), seed, "split"))


def _flagged(with_u: DataFrame, key: str, label: str, test: float) -> DataFrame:
    names = [label, *[c for c in with_u.columns if c not in (label, U)]]
    values = [r[0] for r in with_u.select(col(label)).distinct().limit(MOST_LABELS + 1).collect()]
    cuts = None
    if len(values) <= MOST_LABELS:
        sets = [col(label).eqNullSafe(F.lit(v)) for v in values]
        # half up, as SQL rounds
        _, cuts = rank_cuts(with_u, sets, U, key, lambda sizes: [
            [int(Decimal(repr(test * n)).quantize(Decimal(1), ROUND_HALF_UP))] for n in sizes])
    if cuts is not None:
        chosen = F.lit(False)
        for s, (cut,) in zip(sets, cuts, strict=True):
            chosen = chosen | (s & cut.holds(F.col(U), col(key)))
        return with_u.select(*map(col, names), chosen.alias("is_test"))
    # many labels, or a share that ends between rows of one key: ranks by bucketed prefix counts
    ranked = hash_rank(with_u, [label], U, "_r", tie=key)
    n = with_u.groupBy(col(label).alias(label)).agg(F.count(F.lit(1)).alias("_n"))
    # one row per label value; Catalyst goes by the size
    j = ranked.join(n, on=label, how="inner")
    return j.withColumn("is_test", F.col("_r") <= F.round(F.lit(test) * F.col("_n"))).select(*map(col, names), "is_test")


def stratified_split(df: DataFrame, key: str, label: str, test: float = 0.2,
                     seed: int = 42, materialize: bool = True) -> tuple[DataFrame, DataFrame]:
    """Train and test halves of one table. Both halves are read many
    times downstream (fit passes, scoring, every metric), so by default the
    rows are written once, with their fractions, to the shared checkpoint folder: the halves
    are filters on it, and a lost executor re-reads the written table."""
    with_u = _with_fraction(df, key, label, test, seed)
    if materialize:
        plain = [f"c{i}" for i in range(len(with_u.columns))]  # any column name can be written
        with_u = materialised(with_u.toDF(*plain), "split", "zstd").toDF(*with_u.columns)
    flagged = _flagged(with_u, key, label, test)
    return flagged.where(~F.col("is_test")).drop("is_test"), flagged.where("is_test").drop("is_test")


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 3, seed: int = 42,
                     out: str = "fold") -> DataFrame:
    """Fold id = (rank inside the label by md5 fraction) mod ``folds``:
    class shares equal across folds up to one row."""
    u = "_fold_u"
    return folds_by(df.withColumn(u, unit_hash(col(key), seed, "fold")), u, key, label, folds, out)


def folds_by(df: DataFrame, u: str, tie: str, label: str, folds: int, out: str = "fold") -> DataFrame:
    """``stratified_folds`` by a fraction column ``u``, equal fractions by ``tie``; ``u`` is dropped."""
    ranked = hash_rank(_labelled(df, label), [label], u, "_r", tie=tie)
    return ranked.withColumn(out, ((F.col("_r") - 1) % folds).cast("int")).drop("_r", u)


# --- T6 ----------------------------------------------------------------------
def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, mean, scale)``: population standard deviation, 1 for a
    zero-variance column. One aggregate."""
    row = df.agg(*[a for i, c in enumerate(cols) for a in
                   (F.avg(as_double(c)).alias(f"m{i}"), F.stddev_pop(as_double(c)).alias(f"s{i}"))])
    out = row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"),
                 F.when((F.col(f"s{i}") == 0) | F.col(f"s{i}").isNull(), F.lit(1.0)).otherwise(F.col(f"s{i}")).alias("scale"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*")
    return out


def scaler_dict(scaler: DataFrame) -> dict[str, tuple[float, float]]:
    """One (mean, scale) pair per feature, collected."""
    return {r["column"]: (r["mean"], r["scale"]) for r in scaler.collect()}


def apply_scaler(df: DataFrame, scaler: dict[str, tuple[float, float]] | DataFrame) -> DataFrame:
    """``(x - mean) / scale`` as a narrow projection (literals)."""
    s = scaler_dict(scaler) if isinstance(scaler, DataFrame) else scaler
    return df.select(*[
        ((as_double(c) - F.lit(s[c][0])) / F.lit(s[c][1])).alias(c) if c in s else col(c) for c in df.columns
    ])
