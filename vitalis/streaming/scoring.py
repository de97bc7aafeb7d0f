"""Batch scoring attached to a file stream.

Scoring (S1-S7) is row-wise and stateless: no aggregation, no shuffle, so the
exact same plan runs on a ``readStream`` DataFrame. New record files dropped
in the source folder are scored incrementally; the query's checkpoint lives
in the shared checkpoint folder so a restarted driver or a lost executor
resumes without duplicates (file source + file sink are exactly-once).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vitalis.operators import score as S
from vitalis.session import checkpoint_dir


def read_record_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet",
                       glob: str | None = None, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def scored_stream(stream: DataFrame, pkg, key: str, extra: list[str] | None = None) -> DataFrame:
    """S1-S7 on a stream: scores, display label and verdict per record."""
    return S.verdict(S.patient_label(S.score(stream, pkg, key, extra), key))


def run_to_parquet(stream: DataFrame, out: str, name: str, available_now: bool = True):
    """Start the scoring stream into a parquet folder; returns the query."""
    ckpt = os.path.join(checkpoint_dir(stream.sparkSession), f"stream-{name}")
    writer = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
              .outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
