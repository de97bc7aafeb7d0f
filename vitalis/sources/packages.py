"""Model packages and the registry table.

A package is a folder: ``model/`` (a saved ``PipelineModel``, or the k-NN
training table as parquet), ``meta/`` (one-row parquet with a JSON document:
features, target, model type, parameters, metrics, scaler, importance,
medians), ``codebook/`` and ``scores/`` (test ``label, prob`` for G8). All
writes go through Spark writers, so the folder can live on any shared file
system or object store. The registry is an append-only folder of saved packages' rows, each
written into a folder of its own.
Promotions are a log of their own beside it: version numbers are claimed by exclusive creation of
a marker file, so of two promoters that have seen the same state one wins; the newest version
names the active package.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import threading
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalis.operators.models import KnnModel

REGISTRY_SCHEMA = ("package string, path string, model string, accuracy double, recall double, precision double, "
                   "f1 double, f2 double, auc double, n_features int, features array<string>, target string, "
                   "medians map<string,double>, saved_at timestamp, active_from timestamp")


LOG_SCHEMA = REGISTRY_SCHEMA + ", version long"


@dataclass
class Package:
    model_type: str
    model: object
    features: list[str]
    target: str
    params: dict = field(default_factory=dict)
    metrics: dict = field(default_factory=dict)
    scaler: dict = field(default_factory=dict)          # feature -> (mean, scale)
    importance: dict | None = None                        # feature -> importance
    medians: dict = field(default_factory=dict)           # feature -> median (at promotion)
    codebook: DataFrame | None = None
    scores: DataFrame | None = None                       # label, prob of the test rows
    run_time: str = ""
    null_label: str | None = None                         # the text that stood for NULL in the codebook
    linear: dict | None = None                            # intercept/coefficients of a logistic model

    def meta(self) -> dict:
        return {"model_type": self.model_type, "features": self.features, "target": self.target,
                "params": {k: v for k, v in self.params.items()}, "metrics": self.metrics,
                "scaler": {k: list(v) for k, v in self.scaler.items()}, "importance": self.importance,
                "medians": self.medians, "run_time": self.run_time, "linear": self.linear,
                "null_label": self.null_label, "parts": [n for n in ("codebook", "scores")
                                                         if getattr(self, n) is not None],
                "knn_key": getattr(self.model, "key", None), "knn_k": getattr(self.model, "k", None),
                "knn_weights": getattr(self.model, "weights", None)}


def save_package(pkg: Package, path: str) -> str:
    """Write a package into a fresh folder below ``path``; returns that folder. Earlier saves stay as they are."""
    spark = SparkSession.getActiveSession()
    path = os.path.join(path, f"v-{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}")
    mpath = os.path.join(path, "model")
    if isinstance(pkg.model, KnnModel):
        pkg.model.train.write.mode("overwrite").parquet(mpath)
    elif pkg.model is not None:
        pkg.model.write().overwrite().save(mpath)
    spark.createDataFrame([(json.dumps(pkg.meta(), default=str),)], "meta string") \
        .coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "meta"))
    if pkg.codebook is not None:
        pkg.codebook.write.mode("overwrite").parquet(os.path.join(path, "codebook"))
    if pkg.scores is not None:
        pkg.scores.select("label", "prob").write.mode("overwrite").parquet(os.path.join(path, "scores"))
    return path


def load_package(spark: SparkSession, path: str) -> Package:
    meta = json.loads(spark.read.parquet(os.path.join(path, "meta")).first()["meta"])
    mpath = os.path.join(path, "model")
    if meta["model_type"] == "knn":
        model = KnnModel(spark.read.parquet(mpath), meta["features"], int(meta.get("knn_k") or 5),
                         meta.get("knn_weights") or "uniform", meta.get("knn_key") or "_key")
    elif meta["model_type"] == "linear":
        model = None
    else:
        model = PipelineModel.load(mpath)

    def opt(name):
        return spark.read.parquet(os.path.join(path, name)) if name in meta["parts"] else None

    return Package(model_type=meta["model_type"], model=model, features=meta["features"], target=meta["target"],
                   params=meta.get("params") or {}, metrics=meta.get("metrics") or {},
                   scaler={k: tuple(v) for k, v in (meta.get("scaler") or {}).items()},
                   importance=meta.get("importance"), medians=meta.get("medians") or {},
                   codebook=opt("codebook"), scores=opt("scores"), run_time=meta.get("run_time", ""),
                   null_label=meta.get("null_label"),
                   linear=meta.get("linear"))


def registry_row(spark: SparkSession, pkg: Package, name: str, path: str, active: bool) -> DataFrame:
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    m = pkg.metrics
    row = (name, path, pkg.model_type, m.get("accuracy"), m.get("recall"), m.get("precision"), m.get("f1"),
           m.get("f2"), m.get("auc"), len(pkg.features), pkg.features, pkg.target,
           {k: float(v) for k, v in (pkg.medians or {}).items() if v is not None}, now, now if active else None)
    return spark.createDataFrame([row], REGISTRY_SCHEMA)


def register_package(spark: SparkSession, registry_path: str, pkg: Package, name: str, path: str,
                     active: bool = False) -> None:
    path = save_package(pkg, path)
    _append(registry_row(spark, pkg, name, path, active), registry_path)


def _append(row: DataFrame, folder: str, name: str | None = None) -> None:
    """One more row in a folder of its own: writers that append at the same time do not meet."""
    row.coalesce(1).write.parquet(os.path.join(folder, name or f"row-{uuid.uuid4().hex}"))


def _rows(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of such a folder, none if it does not exist."""
    fs, path = _file(spark, folder)
    if not fs.exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)


def registered(spark: SparkSession, registry_path: str) -> DataFrame:
    """Every saved package of a registry."""
    return _rows(spark, registry_path, REGISTRY_SCHEMA)


class PromotionConflict(RuntimeError):
    """Another promotion took the version that this one was to follow."""


_CLAIMING = threading.Lock()  # local file systems check and create in two steps; this driver's threads take turns


def _file(spark: SparkSession, path: str):
    """(file system, path) by Hadoop's own interface: whatever store the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def promotion_version(spark: SparkSession, registry_path: str) -> int:
    """The newest version that a promotion has claimed, 0 before the first."""
    fs, folder = _file(spark, f"{registry_path.rstrip('/')}-promotions/claims")
    if not fs.exists(folder):
        return 0
    return max((int(s.getPath().getName()) for s in fs.listStatus(folder)), default=0)


def _claim(spark: SparkSession, registry_path: str, version: int) -> bool:
    """Create the version's marker if nobody has; the store decides between two writers."""
    fs, marker = _file(spark, f"{registry_path.rstrip('/')}-promotions/claims/{version:010d}")
    with _CLAIMING:
        try:
            fs.create(marker, False).close()
            return True
        except Py4JJavaError as ex:
            if "AlreadyExists" in str(ex.java_exception.getClass().getName()) or fs.exists(marker):
                return False
            raise


def promotion_log(spark: SparkSession, registry_path: str) -> DataFrame:
    """Every promotion with its version. A version that was claimed by a writer that died has no row."""
    return _rows(spark, f"{registry_path.rstrip('/')}-promotions/rows", LOG_SCHEMA)


def promote(spark: SparkSession, registry_path: str, pkg: Package, name: str, path: str, table: DataFrame,
            expected: int | None = None) -> Package:
    """Attach medians of the package features over the whole cleaned table
    (M4), write the package and its registry row, and append it to the promotion log.

    The log is append-only, its versions count up by one. ``expected`` is the version
    that the caller has seen as the newest (by default the one at the call); if another
    promotion has taken the next version meanwhile, this one raises ``PromotionConflict`` and
    changes nothing that is active."""
    from vitalis.operators.missing import medians_dict

    expected = promotion_version(spark, registry_path) if expected is None else expected
    pkg.medians = medians_dict(table, [f for f in pkg.features if f in table.columns])
    saved = save_package(pkg, path)
    _append(registry_row(spark, pkg, name, saved, False), registry_path)
    if not _claim(spark, registry_path, expected + 1):
        raise PromotionConflict(f"version {expected + 1} was promoted by someone else; look at it and promote again")
    _append(registry_row(spark, pkg, name, saved, True).withColumn("version", F.lit(expected + 1).cast("long")),
            f"{registry_path.rstrip('/')}-promotions/rows", f"{expected + 1:010d}")
    return pkg


def active_info(spark: SparkSession, registry_path: str) -> DataFrame:
    """The active package row (the log's newest version), empty if none."""
    return promotion_log(spark, registry_path).orderBy(F.desc("version")).limit(1)
