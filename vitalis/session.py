"""Session helpers.

Cluster settings (``spark.checkpoint.dir``, shuffle partitions, memory) belong
to whoever launches the job; ``get_spark`` only fills in local defaults for
tests and benchmarks and never overrides a value that is already set.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    # The most that Catalyst broadcasts by its own choice.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(app: str = "vitalis", cores: int | None = None) -> SparkSession:
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = SparkSession.getActiveSession()
    if spark is None:
        given = SparkConf()  # what the launcher submitted
        builder = SparkSession.builder
        for k, v in (LOCAL_DEFAULTS | {"spark.master": f"local[{cores}]", "spark.app.name": app}).items():
            if not given.contains(k):
                builder = builder.config(k, v)
        spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    On a cluster this is ``spark.checkpoint.dir`` as configured by the launcher
    (a shared file system), or the folder set on the context; neither set is an
    error there. Only local tests get a fresh scratch folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="vitalis-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _inside = threading.Lock(), {"depth": 0, "before": "false"}


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What a query inside has shuffled is given back when it ends, not when the driver happens to collect garbage."""
    with _lock:
        if not _inside["depth"]:
            _inside["before"] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _inside["depth"] += 1
    try:
        yield
    finally:
        with _lock:
            _inside["depth"] -= 1
            if not _inside["depth"]:
                spark.conf.set(CLEANUP, _inside["before"])


def materialised(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """The table written to the shared folder and read again: computed once, lineage cut, any executor can read it."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/vitalis-{label}-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
