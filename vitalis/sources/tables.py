"""Table sources and sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalis.functions.columns import col


def read_testdata(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str | None = None) -> DataFrame:
    """Read a table. CSV is read with a header, every column as text
    unless a schema is given (typing is the job of ``coerce_numeric``, not of
    CSV inference); malformed rows are kept (PERMISSIVE). Parquet/ORC/JSON by
    extension or ``fmt``."""
    fmt = fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower() or "parquet"
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        return (reader.option("header", True).option("mode", "PERMISSIVE")
                .option("inferSchema", False).option("encoding", "UTF-8").csv(path))
    return reader.format(fmt).load(path)


def null_total(df: DataFrame) -> int:
    """Number of missing cells (NULL or NaN) in the table — one aggregate."""
    def miss(c: str, dt: T.DataType):
        m = col(c).isNull()
        if isinstance(dt, (T.DoubleType, T.FloatType)):
            m = m | F.isnan(col(c))
        return F.count_if(m)

    if not df.columns:
        return 0
    row = df.agg(*[miss(f.name, f.dataType).alias(f"_m{i}") for i, f in enumerate(df.schema.fields)]).first()
    return int(sum(row))


def write_clean_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the cleaned table as UTF-8 CSV with a header. Offered only for
    a complete table: raises when any cell is missing."""
    missing = null_total(df)
    if missing:
        raise ValueError(f"table still has {missing} missing values; impute or drop first")
    df.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)


def preview(df: DataFrame, n: int, order_cols: list[str]) -> DataFrame:
    """The first ``n`` rows in key order (each task keeps its top n)."""
    return df.orderBy(*[col(c) for c in order_cols]).limit(n)


class MissingColumnsError(ValueError):
    def __init__(self, missing: list[str]):
        super().__init__("missing required columns: " + ", ".join(missing))
        self.missing = missing


def require_columns(df: DataFrame, features: list[str]) -> DataFrame:
    """Stop with the list of absent feature names (schema-only check)."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise MissingColumnsError(missing)
    return df
