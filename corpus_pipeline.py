"""The corpus pipeline: stages applied to ``documents``, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept. All but the last return the columns of ``documents``; a stage that
changes a text sets its n_chars anew. Null texts, empty tables and repeated rows
pass through as each operator documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalis.llm.lines import dedup_lines
from vitalis.llm.minhash import keep_one_per_group
from vitalis.llm.packing import pack_by_retrieval
from vitalis.llm.substrings import dedup_substrings
from vitalis.llm.toxicity import CUTOFF, fit_toxicity, score_toxicity, training_rows
from vitalis.session import checkpoint_dir


def _as_documents(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """``changed`` with the columns of ``docs`` and the length of the text as it is now."""
    kind = docs.schema["n_chars"].dataType
    return changed.select(*(F.char_length("text").cast(kind).alias(c) if c == "n_chars" else F.col(c)
                            for c in docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the cutoff go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fitted = fit_toxicity(docs, training_rows(docs, labels))
    return score_toxicity(docs, fitted, score="toxicity_score").where(F.col("toxicity_score") < CUTOFF).select(
        docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, exactly or nearly, are cut from the texts."""
    return _as_documents(dedup_lines(docs), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return keep_one_per_group(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 13-word windows that an earlier document has are cut from the texts."""
    return _as_documents(dedup_substrings(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as token ids, packed into windows with lexical neighbours."""
    return pack_by_retrieval(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

# The fitted classifier and lexical packing have no SQL form; tests hold run() against brute-force forms.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
