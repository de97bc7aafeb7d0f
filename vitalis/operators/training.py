"""The training run: split, rebalance, scale, fit or search, evaluate, keep.

``train_run`` composes the operators in the studied workflow's order. The split
comes first and is written once; the sampler sees training rows only and the scaler is
fitted on what the sampler made; the test rows are scaled by it and never resampled.
What it returns is what the comparison and promotion operators take: a package with
metrics, scaler, importances and the test scores, and a row for the run history.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalis.functions.columns import as_double, col
from vitalis.operators import evaluate as V
from vitalis.operators import models as ML
from vitalis.operators import prep as P
from vitalis.operators import rebalance as R
from vitalis.operators import registry as G
from vitalis.session import materialised
from vitalis.sources.packages import Package


@dataclass
class RunConfig:
    """What a run needs beside its table. ``candidates``: how many a search tries, 0 for one fit with ``params``."""
    model_type: str
    features: list[str]
    target: str
    key: str
    name: str | None = None
    test: float = 0.2
    sampler: str = "none"
    params: dict = field(default_factory=dict)
    candidates: int = 0
    folds: int = 3
    threshold: float | None = None
    seed: int = 42
    run_time: dt.datetime | None = None


@dataclass
class Run:
    package: Package
    history: DataFrame  # one row, columns of the run history
    counts: dict[str, int]  # rows: train, train_rebalanced, test


def train_run(df: DataFrame, config: RunConfig) -> Run:
    """One run over ``df``; rows without a label or with a missing feature are an error (impute or fill first)."""
    c = config
    if c.model_type not in ML.MODEL_TYPES:
        raise ValueError(f"model_type must be one of {ML.MODEL_TYPES}")
    missing = [f for f in [c.key, c.target, *c.features] if f not in df.columns]
    if missing:
        raise ValueError(f"the table has no columns {missing}")
    gap = F.raise_error(F.lit("a feature is missing: impute or fill those rows before a run")).cast("double")
    rows = df.select(col(c.key), *[F.coalesce(as_double(f), gap).alias(f) for f in c.features], col(c.target))

    train, test = P.stratified_split(rows, c.key, c.target, c.test, c.seed)
    made = materialised(R.rebalance(train, c.sampler, c.key, c.features, c.target, c.seed), "training-rows")
    scaler = P.scaler_dict(P.fit_scaler(made, c.features))
    fit_on, judge_on = P.apply_scaler(made, scaler), P.apply_scaler(test, scaler)
    if c.candidates:
        model, params, _ = ML.random_search(c.model_type, fit_on, c.features, c.target, c.key, c.candidates, c.folds, c.seed)
    else:
        params = dict(c.params)
        model = ML.fit(c.model_type, fit_on, c.features, c.target, params, key=c.key, seed=c.seed)

    scored = ML.predict(model, judge_on.withColumnRenamed(c.target, "label"), c.features, key=c.key)
    scores = materialised(scored.select("label", "prob", "prediction"), "test-scores")
    met = V.metrics(scores, threshold=c.threshold).first()
    values = {m: float(met[m]) for m in G.METRICS if m != "auc"} | {"auc": float(V.auc(scores).first()["auc"])}
    importance = ML.intrinsic_importance(model, c.features, df.sparkSession)
    name, now = c.name or c.model_type, c.run_time or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    package = Package(
        model_type=c.model_type, model=model, features=list(c.features), target=c.target, params=params, metrics=values,
        scaler=scaler, importance=None if importance is None else {r["feature"]: r["importance"] for r in importance.collect()},
        scores=scores.select("label", "prob"), run_time=now.isoformat())
    history = df.sparkSession.createDataFrame(
        [(f"{name} - {now:%H:%M:%S}", name, *[values[m] for m in G.METRICS], len(c.features), c.threshold, now)], G.HISTORY_SCHEMA)
    counts = {"train": train.count(), "train_rebalanced": made.count(), "test": scores.count()}
    return Run(package, history, counts)

