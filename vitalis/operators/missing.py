"""Missing data (M1-M4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalis.functions.brackets import bracket_quantiles
from vitalis.functions.columns import as_double, col, numeric_columns


def missing_profile(df: DataFrame) -> DataFrame:
    """M1: ``(column, n_missing, pct)`` for columns with at least one missing
    cell (NULL, or NaN in floating columns), count descending. One aggregate."""
    fields = df.schema.fields

    def miss(f: T.StructField):
        m = col(f.name).isNull()
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            m = m | F.isnan(col(f.name))
        return F.count_if(m)

    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[miss(f).alias(f"_m{i}") for i, f in enumerate(fields)])
    long = row.select("_rows", F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.col(f"_m{i}").alias("n_missing")) for i, f in enumerate(fields)
    ])).alias("r")).select("_rows", "r.*")
    return (long.where(F.col("n_missing") > 0)
            .select("column", F.col("n_missing").cast("long").alias("n_missing"),
                    (F.col("n_missing") * 100.0 / F.col("_rows")).alias("pct"))
            .orderBy(F.desc("n_missing"), "column"))


def drop_candidates(df: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` columns with most missing cells (offered for P7)."""
    return missing_profile(df).limit(k)


def fill_medians(df: DataFrame, features: list[str], medians: dict[str, float] | None) -> DataFrame:
    """M3: fill feature nulls from stored medians; 0 when none were stored
    (and for a feature without a stored median)."""
    medians = medians or {}
    return df.select(*[
        F.coalesce(as_double(c), F.lit(float(medians.get(c) if medians.get(c) is not None else 0.0))).alias(c)
        if c in features else col(c) for c in df.columns
    ])


def feature_medians(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """M4: exact median (linear interpolation) of each column over the whole
    table: ``(column, median)``."""
    cols = cols if cols is not None else numeric_columns(df)
    return bracket_quantiles(df, [], cols, [0.5]).where("n > 0").select("column", F.col("q_0").alias("median"))


def medians_dict(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """M4 collected: one number per feature."""
    return {r["column"]: r["median"] for r in feature_medians(df, cols).collect()}


# --- M2 ----------------------------------------------------------------------
def knn_impute(df: DataFrame, key: str, cols: list[str] | None = None, k: int = 5, leaf: int | None = None) -> DataFrame:
    """M2: k-nearest-neighbour imputation (uniform weights) over ``cols`` with
    the NaN-aware Euclidean distance; donors for a column are the rows that
    have it, ties go to the smaller key; a receiver without any comparable donor
    gets the column mean, a column without any value stays null.

    Exact: k-d trees per pattern of present columns (``operators.kdtree``). The key must be unique and not null."""
    from vitalis.operators.kdtree import LEAF, nearest_donors

    cols = cols if cols is not None else [c for c in numeric_columns(df) if c != key]
    if len(cols) > 62:
        raise ValueError("at most 62 columns can be imputed together")
    base = df.select(col(key).alias("key"), *[as_double(c).alias(f"x{i}") for i, c in enumerate(cols)])
    near = nearest_donors(base, len(cols), k, leaf or LEAF)
    means = base.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(cols))]).first()  # one number per column
    wide = near.groupBy("key").agg(*[F.avg(F.when(F.col("c") == i, F.col("value"))).alias(f"_i{i}")
                                     for i in range(len(cols))]).withColumnRenamed("key", "_key")
    out = df.join(wide, df[key] == wide["_key"], "left")
    return out.select(*[
        F.coalesce(as_double(c), F.col(f"_i{cols.index(c)}"), F.lit(means[cols.index(c)]).cast("double")).alias(c)
        if c in cols else df[c] for c in df.columns
    ])
