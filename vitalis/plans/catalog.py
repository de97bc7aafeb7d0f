"""Registered queries: one per operator of the inventory, each with a DuckDB
oracle where the semantics are SQL-expressible.

Every query reads whole TESTDATA tables through ``plans.fixtures``. Double
outputs are rounded (6 places, fewer for money-scale sums) identically on both
sides so the comparison is insensitive to summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalis.functions.columns import col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6, per_column: dict[str, int] | None = None) -> DataFrame:
    per_column = per_column or {}
    return df.select(*[
        F.round(col(f.name), per_column.get(f.name, digits)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else col(f.name)
        for f in df.schema.fields
    ])


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


# import the query modules so their ``register`` calls run
from vitalis.plans import queries_clean as _qc  # noqa: E402,F401
from vitalis.plans import queries_explore as _qe  # noqa: E402,F401
from vitalis.plans import queries_evaluate as _qv  # noqa: E402,F401
from vitalis.plans import queries_prep as _qp  # noqa: E402,F401
from vitalis.plans import queries_models as _qm  # noqa: E402,F401
from vitalis.plans import queries_score as _qs  # noqa: E402,F401
from vitalis.plans import queries_io as _qi  # noqa: E402,F401
