"""How much data there is, and how many chunks and buckets it is dealt into.

One narrow aggregate (rows, bytes) sizes an operator. Chunks hold a bounded
number of bytes, so their number grows with the input and no task's memory
does.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalis.functions.columns import col
from vitalis.session import checkpoint_dir

CHUNK_BYTES = 4 << 20


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def measured(df: DataFrame, text_col: str) -> tuple[int, int]:
    """(rows, bytes of text) of a table."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(col(text_col))).alias("b")).first()
    return row["n"], row["b"] or 0


def chunks_for(spark: SparkSession, total_bytes: int, chunk_bytes: int = CHUNK_BYTES) -> int:
    return max(2 * shuffle_partitions(spark), math.ceil(total_bytes / chunk_bytes), 1)


def power_bits(least: int) -> int:
    """The smallest b with 2**b >= least."""
    return max(0, math.ceil(math.log2(max(1, least))))


def chunk_of(columns: list[Column], chunks: int) -> Column:
    """A chunk number from a hash of the row's own content: a row computed again lands in the same chunk."""
    return F.pmod(F.xxhash64(*columns), F.lit(chunks)).cast("long")


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names for working columns that clash with none of the table's own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def written(df: DataFrame, label: str) -> DataFrame:
    """The table written to the shared folder and read again: cuts the lineage, is computed once."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/vitalis-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
