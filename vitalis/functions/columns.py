"""Column-name and type helpers.

Clinical headers carry dots, spaces and slashes (``D.O.A``,
``TYPE OF ADMISSION-EMERGENCY/OPD``); every reference goes through ``col``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.FloatType, T.DoubleType, T.DecimalType,
)


def q(name: str) -> str:
    """Back-tick quote a column name for use inside an expression string."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def as_double(name: str) -> Column:
    """Numeric column as double with NaN normalised to NULL (Spark keeps NaN
    apart from NULL; the analytics treat both as missing)."""
    c = col(name).cast("double")
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def long_form(df: DataFrame, columns: list[str], ids: list[str] | None = None,
              name: str = "column", value: str = "value") -> DataFrame:
    """Unpivot ``columns`` (cast to double) to ``(ids..., name, value)``."""
    ids = ids or []
    safe = {c: f"_v{i}" for i, c in enumerate(columns)}
    wide = df.select(*[col(i) for i in ids], *[as_double(c).alias(safe[c]) for c in columns])
    stacked = wide.select(
        *[col(i) for i in ids],
        F.explode(F.array(*[
            F.struct(F.lit(c).alias(name), F.col(safe[c]).alias(value)) for c in columns
        ])).alias("_kv"),
    )
    return stacked.select(*[col(i) for i in ids], F.col(f"_kv.{name}").alias(name),
                          F.col(f"_kv.{value}").alias(value))
