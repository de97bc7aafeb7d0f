"""Classifiers (F1-F9) on Spark ML.

Every model is a ``PipelineModel`` whose output carries ``probability`` and
``prediction``; ``predict`` turns that into plain ``prob`` / ``prediction``
columns. The k-NN classifier keeps its training table (written to the package
folder) and predicts with the exact grid k-NN join.

Mappings of the studied library parameters (documented approximations):

* logistic regression ``C`` -> ``regParam = 1/(C*n)``, L2, no standardisation;
* random forest depth None -> 30 (Spark's maximum);
* XGBoost -> ``GBTClassifier`` (same trees/depth/rate/subsample; different
  regularisation and missing-value handling);
* SVM linear, rbf (random Fourier features, Rahimi & Recht 2007) or poly (sign-projection
  sketch) -> rounded hinge loss by Newton steps, all folds in one scan; probabilities by Platt's sigmoid
  on out-of-fold margins.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Bucketizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalis.functions.columns import as_double, col, q
from vitalis.functions.ranking import hash_rank
from vitalis.functions.rng import permuted_rank, unit_hash
from vitalis.operators.many_models import (
    BEND, MOST_MODELS, Linear, as_table, curve_rows, fit_many, hinge_loss, judge_many, mask_of, platt,
)
from vitalis.session import materialised

MODEL_TYPES = ["logreg", "forest", "boost", "svm", "knn"]

BINS = 32  # of a feature; Spark's trees see no more of a number either
ROWS_A_TASK = 500_000
MANY_ROWS = 1_000_000  # from here on boosting and forests take rows of equal bins together


def _plain(features: list[str]) -> tuple[list, list[str]]:
    """Stages and names: Spark ML reads a dot in a name as a field, so names that are not plain get plain copies first."""
    if all(re.fullmatch(r"\w+", f) for f in features):
        return [], features
    names = [f"_x{i}" for i in range(len(features))]
    copies = ", ".join(f"{q(f)} AS {x}" for f, x in zip(features, names, strict=True))
    return [SQLTransformer(statement=f"SELECT *, {copies} FROM __THIS__")], names


def _assembler(features: list[str], out: str = "features") -> list:
    """Stages that gather the features."""
    stages, names = _plain(features)
    return [*stages, VectorAssembler(inputCols=names, outputCol=out, handleInvalid="keep")]


def _prepare(df: DataFrame, features: list[str], label: str | None) -> DataFrame:
    cols = [as_double(f).alias(f) for f in features]
    keep = [c for c in df.columns if c not in features and c != label]
    if label is not None and label in df.columns:
        cols.append(as_double(label).alias("label"))
    return df.select(*[col(c) for c in keep], *cols)


# --- F4 feature maps --------------------------------------------------------------
def _waves(width: int, gamma: float, n_components: int, seed: int):
    """Frequencies and phases of the random Fourier features."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(n_components, width))
    return w, rng.uniform(0.0, 2 * math.pi, size=n_components)


def _signs(width: int, degree: int, n_components: int, seed: int):
    return np.random.default_rng(seed).integers(0, 2, (n_components, degree, width))


def rff_features(width: int, gamma: float, n_components: int = 200, seed: int = 42):
    """The map of ``rff_transformer`` on blocks of rows inside a task."""
    w, b = _waves(width, gamma, n_components, seed)
    scale = math.sqrt(2.0 / n_components)
    return lambda x: scale * np.cos(x @ w.T + b)


def maclaurin_features(width: int, gamma: float, degree: int = 3, n_components: int = 200, seed: int = 42):
    """The map of ``maclaurin_transformer`` on blocks of rows inside a task."""
    signs = 2.0 * _signs(width, degree, n_components, seed) - 1.0
    scale = math.sqrt(gamma ** degree / n_components)

    def run(x):
        out = scale * (x @ signs[:, 0].T)
        for d in range(1, degree):
            out *= x @ signs[:, d].T
        return out
    return run


def rff_transformer(features: list[str], gamma: float, n_components: int = 200, seed: int = 42) -> SQLTransformer:
    """Random Fourier features for the RBF kernel ``exp(-gamma |x - y|^2)``:
    ``z_j = sqrt(2/D) cos(w_j . x + b_j)``, ``w ~ N(0, 2 gamma)``, ``b ~ U[0, 2pi)``.
    Written as SQL so it is a saveable pipeline stage and runs in codegen."""
    w, b = _waves(len(features), gamma, n_components, seed)
    scale = math.sqrt(2.0 / n_components)
    parts = []
    for j in range(n_components):
        lin = " + ".join(f"({float(w[j, i])!r}) * {q(f)}" for i, f in enumerate(features))
        parts.append(f"{float(scale)!r} * cos({lin} + ({float(b[j])!r})) AS _rff{j}")
    return SQLTransformer(statement="SELECT *, " + ", ".join(parts) + " FROM __THIS__")


def gamma_value(df: DataFrame, features: list[str], gamma: str | float) -> float:
    """``scale`` = 1 / (n_features * variance of all feature values); ``auto`` = 1 / n_features."""
    if isinstance(gamma, (int, float)):
        return float(gamma)
    if gamma == "auto":
        return 1.0 / len(features)
    # variance over all cells, from per-column sums (one aggregate)
    row = df.agg(*[a for i, f in enumerate(features) for a in
                   (F.count(as_double(f)).alias(f"n{i}"), F.sum(as_double(f)).alias(f"s{i}"),
                    F.sum(as_double(f) * as_double(f)).alias(f"q{i}"))]).first()
    n = sum(row[f"n{i}"] for i in range(len(features)))
    s = sum(row[f"s{i}"] or 0.0 for i in range(len(features)))
    s2 = sum(row[f"q{i}"] or 0.0 for i in range(len(features)))
    var = s2 / n - (s / n) ** 2 if n else 0.0
    return 1.0 / (len(features) * var) if var > 0 else 1.0


def maclaurin_transformer(features: list[str], gamma: float, degree: int = 3, n_components: int = 200,
                          seed: int = 42) -> SQLTransformer:
    """A sketch of the polynomial kernel ``(gamma x.y)^degree``: each component is a product of ``degree``
    random sign projections (Kar & Karnick 2012), as many components however many monomials there are."""
    signs = _signs(len(features), degree, n_components, seed)
    scale = math.sqrt(gamma ** degree / n_components)
    parts = []
    for j in range(n_components):
        forms = ["(" + " ".join(f"{'+' if s else '-'} {q(f)}" for s, f in zip(row, features, strict=True)) + ")" for row in signs[j]]
        parts.append(f"{scale!r} * {' * '.join(forms)} AS _map{j}")
    return SQLTransformer(statement="SELECT *, " + ", ".join(parts) + " FROM __THIS__")


def fit_svm(data: DataFrame, features: list[str], params: dict, seed: int = 42) -> PipelineModel:
    """a support vector machine with calibrated probabilities.

    The kernel is a feature map (none, random Fourier features or a polynomial sketch). The machine
    on all rows and those on three folds' complements minimise the rounded hinge loss together
    (``many_models``); each row's margin by the machine that has not seen it goes into Platt's
    sigmoid with smoothed targets. A row's fold comes from a hash of its features. The result
    is a pipeline of SQL stages that ends in ``svm_margin``, ``svm_prob`` and ``prediction``."""
    c, kernel = float(params.get("C", 1.0)), params.get("kernel", "rbf")
    if kernel not in ("linear", "rbf", "poly"):
        raise ValueError(f"unknown kernel {kernel!r}")
    stages, mapped, made = [], features, None
    if kernel != "linear":
        g, nc = gamma_value(data, features, params.get("gamma", "scale")), int(params.get("n_components", 200))
        if kernel == "rbf":
            stages.append(rff_transformer(features, g, nc, seed))
            made = rff_features(len(features), g, nc, seed)
        else:
            degree = int(params.get("degree", 3))
            stages.append(maclaurin_transformer(features, g, degree, nc, seed))
            made = maclaurin_features(len(features), g, degree, nc, seed)
        mapped = [f"{'_rff' if kernel == 'rbf' else '_map'}{j}" for j in range(nc)]
    folds = 3
    fold = F.pmod(F.xxhash64(F.lit(seed), *map(col, features)), F.lit(folds))
    rows = data.withColumn("_svm_fold", fold)
    train = mask_of([F.lit(True)] + [F.col("_svm_fold") != f for f in range(folds)])
    test = mask_of([F.col("_svm_fold") == f for f in range(folds)])
    # the map is taken inside the tasks: the table keeps the features' own width
    table = materialised(as_table(rows, features, "label", train, test), "svm-rows")
    xs = [f"x{i}" for i in range(len(features))]
    seen = table.agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") != 1).alias("n")).first()
    whole, *parts = fit_many(table.select("mask", "y", *xs), len(xs), [c] * (folds + 1), tolerance=1e-9, losses=hinge_loss,
                             features=made, mapped=len(mapped), most_curvature=1 / BEND, rows=seen["p"] + seen["n"])
    if not all(m.converged for m in (whole, *parts)):
        raise RuntimeError("the support vector machine has not converged: scale the features or lower C")
    if not seen["p"] or not seen["n"]:
        raise ValueError("the training rows hold one class only")
    # a fold whose complement has one class gives no margins
    usable = [m if math.isfinite(m.intercept) else Linear(np.zeros(len(mapped)), 0.0, 0, 0, True) for m in parts]
    a, b = platt(table.select(F.col("test").alias("mask"), "y", *xs), len(xs), usable, seen["p"], seen["n"], features=made)
    margin = " + ".join([f"({float(whole.intercept)!r})"] + [f"({float(w)!r}) * {q(m)}" for w, m in zip(whole.coefficients, mapped, strict=True)])
    stages += [SQLTransformer(statement=f"SELECT *, {margin} AS svm_margin FROM __THIS__"),
               SQLTransformer(statement=f"SELECT *, 1.0 / (1.0 + exp(-(({a!r}) * svm_margin + ({b!r})))) AS svm_prob, "
                                        "CASE WHEN svm_margin > 0 THEN 1.0D ELSE 0.0D END AS prediction FROM __THIS__")]
    return PipelineModel(stages)


# --- estimators -----------------------------------------------------------------
def build_pipeline(model_type: str, features: list[str], params: dict, n_train: int,
                   train: DataFrame | None = None, seed: int = 42) -> Pipeline:
    """The Spark ML pipeline for one model type and parameter set.

    Trees walk a row from the root in each pass: cached node ids would keep a number for each row and tree,
    written again for every level and checkpoint."""
    p = dict(params)
    if model_type == "logreg":
        c = float(p.get("C", 1.0))
        clf = LogisticRegression(regParam=1.0 / (c * n_train), elasticNetParam=0.0, standardization=False,
                                 maxIter=int(p.get("max_iter", 100)), tol=1e-6)
        return Pipeline(stages=[*_assembler(features), clf])
    if model_type == "forest":
        depth = p.get("depth", 10)
        clf = RandomForestClassifier(numTrees=int(p.get("trees", 100)), maxDepth=30 if depth is None else int(min(depth, 30)),
                                     minInstancesPerNode=max(1, math.ceil(int(p.get("min_samples_split", 2)) / 2)),
                                     seed=seed, maxMemoryInMB=1024, cacheNodeIds=False)
        return Pipeline(stages=[*_assembler(features), clf])
    if model_type == "boost":
        clf = GBTClassifier(maxIter=int(p.get("trees", 100)), maxDepth=int(p.get("depth", 6)),
                            stepSize=float(p.get("rate", 0.3)), subsamplingRate=float(p.get("subsample", 1.0)),
                            seed=seed, maxMemoryInMB=1024, cacheNodeIds=False)
        return Pipeline(stages=[*_assembler(features), clf])
    raise ValueError(f"unknown model type {model_type}")


def bin_bounds(data: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Strictly rising bounds between at most ``bins`` bins of each feature (double or null), by one or two aggregates.

    A feature of few values has a bin for each; of another one the bounds are quantiles, and
    a value that is several of them has a bin of its own."""
    ranks = [k / bins for k in range(1, bins)]
    row = data.agg(*[a for i, f in enumerate(features) for a in (
        F.percentile_approx(col(f), ranks, 10_000).alias(f"q{i}"), F.approx_count_distinct(col(f)).alias(f"d{i}"))]).first()
    few = [i for i in range(len(features)) if row[f"d{i}"] <= 2 * bins]
    sets = data.agg(*[F.sort_array(F.collect_set(col(features[i]))).alias(f"s{i}") for i in few]).first() if few else {}
    out = []
    for i in range(len(features)):
        values = sets[f"s{i}"] if i in few else None
        if values is not None and len(values) <= bins:
            bounds = {a / 2 + b / 2 for a, b in itertools.pairwise(values)} or {values[0] if values else 0.0}
        else:
            marks = row[f"q{i}"]
            bounds = {*marks, *(math.nextafter(a, math.inf) for a, b in itertools.pairwise(marks) if a == b)}
        out.append(sorted(b for b in bounds if math.isfinite(b)) or [0.0])
    return out


def binned_rows(data: DataFrame, features: list[str]) -> tuple[list, list[str], list[list[float]], DataFrame]:
    """Stages that put the features in bins, their names, the bounds, and the rows of equal bins and label with their number."""
    stages, names = _plain(features)
    binned = [f"_bin{i}" for i in range(len(features))]
    bounds = bin_bounds(data, features)
    stages.append(Bucketizer(splitsArray=[[-math.inf, *b, math.inf] for b in bounds], inputCols=names, outputCols=binned,
                             handleInvalid="keep"))  # in scoring a missing value goes the way of the largest, as in any tree
    gap = F.raise_error(F.lit("features must not be missing or infinite in a fit")).cast("double")
    known = data.select(*[F.when(F.abs(col(f)) < math.inf, col(f)).otherwise(gap).alias(f) for f in features], "label")
    rows = PipelineModel(stages).transform(known)
    return stages, binned, bounds, rows.groupBy(*binned, "label").agg(F.count(F.lit(1)).cast("double").alias("_weight"))


def fit_forest_binned(data: DataFrame, features: list[str], params: dict, n_train: int, seed: int = 42) -> PipelineModel:
    """F2 on many rows, from rows of equal bins (``operators.forest_bins``); the model cuts the features themselves."""
    from vitalis.operators.forest_bins import fit_cells

    *stages, classifier = build_pipeline("forest", features, params, n_train, data, seed).getStages()
    _, _, bounds, rows = binned_rows(data, features)
    gap = F.raise_error(F.lit("the label must not be missing in a fit")).cast("double")
    rows = rows.withColumn("label", F.coalesce("label", gap))
    return PipelineModel([*stages, fit_cells(rows, len(features), bounds, classifier, seed, ROWS_A_TASK)])


def fit_boost_binned(data: DataFrame, features: list[str], params: dict, n_train: int, seed: int = 42) -> PipelineModel:
    """F3 on many rows: trees see a row's bins and label alone, so rows that share them are one row with their number
    as weight. The passes of every level then read at most as many rows as there are different bins, whatever the input."""
    stages, binned, _, rows = binned_rows(data, features)
    rows = materialised(rows, "boost-rows")
    # every level of every tree is a job: as many tasks as there are cores and rows for, not one for each shuffle partition
    n_rows = rows.count()
    tasks = max(1, min(data.sparkSession.sparkContext.defaultParallelism, n_rows // 10_000), n_rows // ROWS_A_TASK)
    # the bins are in order: without their attributes, that call them names, trees cut between neighbours
    rows = rows.select(*[F.col(b).alias(b, metadata={}) for b in binned], "label", "_weight").repartition(tasks).cache()
    try:
        fitted = build_pipeline("boost", binned, params, n_train, rows, seed)
        fitted.getStages()[-1].setWeightCol("_weight").setMaxBins(BINS)
        return PipelineModel([*stages, *fitted.fit(rows).stages])
    finally:
        rows.unpersist()


@dataclass
class KnnModel:
    """the training table plus k and weighting."""
    train: DataFrame
    features: list[str]
    k: int = 5
    weights: str = "uniform"
    key: str = "_key"

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        from vitalis.operators.neighbours import knn_join

        nn = knn_join(df.select(*map(col, [key, *self.features])), self.train, qkey=key, pkey=self.key,
                      features=self.features, k=self.k, carry=["label"])
        if self.weights == "distance":
            d = F.sqrt("d2")
            any_zero = F.max((d == 0).cast("int")).over(_w_query())
            w = F.when(any_zero == 1, (d == 0).cast("double")).otherwise(1.0 / d)
            nn = nn.withColumn("_w", w)
        else:
            nn = nn.withColumn("_w", F.lit(1.0))
        prob = nn.groupBy("query_key").agg((F.sum(F.col("_w") * F.col("label")) / F.sum("_w")).alias("prob"))
        out = df.join(prob, col(key) == F.col("query_key"), "left").drop("query_key")
        return out.withColumn("prediction", F.when(F.col("prob") > 0.5, 1.0).otherwise(0.0))


def _w_query():
    from pyspark.sql import Window
    return Window.partitionBy("query_key")


def fit(model_type: str, train: DataFrame, features: list[str], label: str, params: dict | None = None,
        key: str | None = None, seed: int = 42):
    """Fit one model on ``train`` (features already cleaned/scaled)."""
    params = params or {}
    data = _prepare(train, features, label)
    if model_type == "knn":
        key = key or "_key"
        if key not in data.columns:
            data = data.withColumn(key, F.monotonically_increasing_id())
        return KnnModel(data.select(*map(col, [key, *features, "label"])), features, int(params.get("k", 5)),
                        params.get("weights", "uniform"), key)
    data = data.select(*map(col, features), "label").cache()  # a fit reads nothing else
    try:
        if model_type == "svm":
            return fit_svm(data, features, params, seed)
        n = data.count()
        if model_type == "boost" and n >= MANY_ROWS and float(params.get("subsample", 1.0)) == 1.0:
            return fit_boost_binned(data, features, params, n, seed)  # a subsample is drawn row by row
        if model_type == "forest" and n >= MANY_ROWS:
            return fit_forest_binned(data, features, params, n, seed)
        return build_pipeline(model_type, features, params, n, data, seed).fit(data)
    finally:
        data.unpersist()


def predict(model, df: DataFrame, features: list[str], key: str | None = None) -> DataFrame:
    """Add ``prob`` (class-1 probability) and ``prediction`` (0/1 double)."""
    if isinstance(model, KnnModel):
        return model.predict(df, key)
    data = _prepare(df, features, None) if all(f in df.columns for f in features) else df
    out = model.transform(data)
    prob = F.col("svm_prob") if "svm_prob" in out.columns else vector_to_array("probability").getItem(1)
    keep = [c for c in data.columns]
    return out.select(*[col(c) for c in keep], prob.alias("prob"), F.col("prediction").cast("double").alias("prediction"))


# --- F9 ------------------------------------------------------------------------------
def intrinsic_importance(model, features: list[str], spark) -> DataFrame | None:
    """Tree importances, else |coefficients|; None for models without either."""
    if isinstance(model, KnnModel):
        return None
    clf = model.stages[-1]
    if isinstance(clf, SQLTransformer):  # a support vector machine; only the linear kernel weighs the features themselves
        if len(model.stages) > 2:
            return None
        weights = re.findall(r"\((-?[0-9.e+-]+)\) \* ", model.stages[0].getStatement())
        return spark.createDataFrame(list(zip(features, [abs(float(w)) for w in weights], strict=True)), "feature string, importance double")
    vals = None
    if hasattr(clf, "featureImportances"):
        vals = clf.featureImportances.toArray().tolist()
    elif hasattr(clf, "coefficients") and clf.numFeatures == len(features):
        vals = [abs(v) for v in clf.coefficients.toArray().tolist()]
    if vals is None:
        return None
    return spark.createDataFrame(list(zip(features, [float(v) for v in vals])), "feature string, importance double")


# --- F6 ------------------------------------------------------------------------------
SEARCH_SPACES = {
    # fixed values: the candidate lists of the studied application's random search
    "svm": {"C": [0.1, 1, 10, 100], "kernel": ["linear", "rbf", "poly"], "gamma": ["scale", "auto", 0.1, 0.01]},
    "forest": {"trees": [50, 100, 200, 300], "depth": [None, 10, 20, 30], "min_samples_split": [2, 5, 10]},
    "logreg": {"C": [0.01, 0.1, 1, 10, 100]},
    "knn": {"k": list(range(3, 20)), "weights": ["uniform", "distance"]},
    "boost": {"trees": [50, 100, 200, 300], "depth": [3, 5, 7, 10], "rate": [0.01, 0.05, 0.1, 0.2],
              "subsample": [0.6, 0.8, 1.0]},
}


def sample_grid(space: dict, n_iter: int, seed: int = 42) -> list[dict]:
    """``n_iter`` distinct parameter sets drawn from the full grid (all of it
    when smaller), ordered by an md5 of (seed, parameters)."""
    names = sorted(space)
    combos = [dict(zip(names, vals)) for vals in itertools.product(*[space[n] for n in names])]
    combos.sort(key=lambda d: hashlib.md5(f"{seed}|{sorted(d.items())!r}".encode()).hexdigest())
    return combos[:n_iter]


def recall_of_class1(scored: DataFrame) -> float:
    r = scored.agg(F.count_if((F.col("label") == 1) & (F.col("prediction") == 1)).alias("tp"),
                   F.count_if(F.col("label") == 1).alias("p")).first()
    return (r["tp"] / r["p"]) if r["p"] else 0.0


def knn_search_scores(data: DataFrame, features: list[str], key: str, cands: list[dict], folds: int) -> list[float]:
    """Mean class-1 recall of every k and weighting over the folds of ``data`` (with ``fold`` and ``label``).

    One neighbour list per fold, as long as the largest k: a smaller k is a prefix of
    it, so all candidates' votes are sums over the list's first ranks, in one aggregate."""
    from vitalis.operators.neighbours import knn_join

    longest = max(int(c.get("k", 5)) for c in cands)
    rows = []
    for f in range(folds):
        test = data.where(F.col("fold") == f).select(col(key).alias("_q"), *map(col, features), F.col("label").alias("_truth"))
        near = knn_join(test.select("_q", *map(col, features)), data.where(F.col("fold") != f), qkey="_q", pkey=key,
                        features=features, k=longest, carry=["label"])
        exact = F.col("d2") == 0
        # a query with an exact match in reach counts its exact matches alone: rank 1 is one then
        close = F.max(F.when(F.col("rank") == 1, exact.cast("int"))).over(_w_query()) == 1
        near = near.withColumn("_w", F.when(close, exact.cast("double")).otherwise(1.0 / F.sqrt("d2")))
        sums = []
        for i, c in enumerate(cands):
            w = F.when(F.col("rank") <= int(c.get("k", 5)), F.col("_w") if c.get("weights") == "distance" else F.lit(1.0))
            sums += [F.sum(w * F.col("label")).alias(f"_a{i}"), F.sum(w).alias(f"_b{i}")]
        votes = near.groupBy("query_key").agg(*sums)
        judged = test.select("_q", "_truth").join(votes, F.col("_q") == F.col("query_key"), "left").where("_truth = 1")
        rows.append(judged.agg(F.count(F.lit(1)).alias("p"), *[
            F.count_if(F.col(f"_a{i}") / F.col(f"_b{i}") > 0.5).alias(f"tp{i}") for i in range(len(cands))]).first())
    return [float(np.mean([r[f"tp{i}"] / r["p"] if r["p"] else 0.0 for r in rows])) for i in range(len(cands))]


def _narrow(df: DataFrame, features: list[str], label: str, key: str, seed: int) -> DataFrame:
    """Key, features and label with what the folds need of the key: its fraction, and a digest that orders equal fractions."""
    return _prepare(df, features, label).select(col(key), *map(col, features), "label", F.xxhash64(col(key)).alias("_tie"),
                                                unit_hash(col(key), seed, "fold").alias("_fold_u"))


def random_search(model_type: str, train: DataFrame, features: list[str], label: str, key: str,
                  n_iter: int = 10, folds: int = 3, seed: int = 42, space: dict | None = None,
                  parallelism: int = 4):
    """random search scored by class-1 recall over stratified folds, then
    a refit of the best parameters on all rows. Returns (model, best_params,
    results list). Spark ML models go through ``CrossValidator`` with a fold
    column; logistic candidates share every pass (``operators.many_models``), k-NN
    candidates one neighbour list per fold."""
    from vitalis.operators.prep import folds_by, stratified_folds

    cands = sample_grid(space or SEARCH_SPACES[model_type], n_iter, seed)
    if model_type == "logreg":  # every fold and candidate advances in the same passes, over one written table
        data = folds_by(_narrow(train, features, label, key, seed).drop(key), "_fold_u", "_tie", "label", folds)
        pairs = [(float(c["C"]), f) for c in cands for f in range(folds)]
        table = materialised(as_table(data, features, "label", mask_of([F.col("fold") != f for f in range(folds)]),
                                      mask_of([F.col("fold") == f for f in range(folds)])), "search", "zstd")
        xs = [f"x{i}" for i in range(len(features))]

        def spread(bits):
            """The bit of each fold for every candidate."""
            return mask_of([F.col(bits).bitwiseAND(F.lit(1 << f)) != 0 for _, f in part])

        vals = []
        for a in range(0, len(pairs), MOST_MODELS):
            part = pairs[a:a + MOST_MODELS]
            fitted = fit_many(table.select(spread("mask").alias("mask"), "y", *xs), len(xs), [c for c, _ in part])
            vals += [tp / p if p else 0.0 for _, _, p, tp in
                     judge_many(table.select(spread("test").alias("mask"), "y", *xs), len(xs), fitted)]
        scores = [float(np.mean(vals[k * folds:(k + 1) * folds])) for k in range(len(cands))]
        best = int(np.argmax(scores))
        rows = table.select(*[F.col(x).alias(f) for x, f in zip(xs, features, strict=True)], F.col("y").alias("label"))
        model = build_pipeline(model_type, features, cands[best], rows.count(), rows, seed).fit(rows)  # C counts all rows
        return model, cands[best], list(zip(cands, scores))

    data = stratified_folds(_prepare(train, features, label).withColumn(key, col(key)), key, "label", folds, seed).cache()
    n = data.count() * (folds - 1) / folds  # rows that a fold's fit sees: C is per row

    def refit(scores: list[float]):
        """The best parameters fitted on all rows, where C counts all of them."""
        best = int(np.argmax(scores))
        model = fit(model_type, data, features, "label", cands[best], key=key, seed=seed)
        if model_type != "knn":  # a k-NN model keeps its training rows
            data.unpersist()
        return model, cands[best], list(zip(cands, scores))

    if model_type != "knn" and not (model_type == "svm"):
        base = build_pipeline(model_type, features, cands[0], n, data, seed)
        clf = base.getStages()[-1]
        grid = []
        for c in cands:
            m = {}
            for name, val in c.items():
                if model_type == "forest":
                    if name == "trees":
                        m[clf.numTrees] = int(val)
                    elif name == "depth":
                        m[clf.maxDepth] = 30 if val is None else int(val)
                    elif name == "min_samples_split":
                        m[clf.minInstancesPerNode] = max(1, math.ceil(int(val) / 2))
                elif model_type == "boost":
                    attr = {"trees": clf.maxIter, "rate": clf.stepSize, "depth": clf.maxDepth,
                            "subsample": clf.subsamplingRate}[name]
                    m[attr] = val
            grid.append(m)
        ev = MulticlassClassificationEvaluator(metricName="recallByLabel", metricLabel=1.0)
        cv = CrossValidator(estimator=base, estimatorParamMaps=grid, evaluator=ev, foldCol="fold", numFolds=folds,
                            parallelism=parallelism, seed=seed)
        scores = list(cv.fit(data).avgMetrics)
        return refit(scores)

    if model_type == "knn":
        return refit(knn_search_scores(data, features, key, cands, folds))

    def score(c: dict) -> float:
        vals = []
        for f in range(folds):
            tr, va = data.where(F.col("fold") != f), data.where(F.col("fold") == f)
            m = fit(model_type, tr, features, "label", c, key=key, seed=seed)
            vals.append(recall_of_class1(predict(m, va, features, key)))
        return float(np.mean(vals))

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        scores = list(pool.map(score, cands))
    return refit(scores)


# --- F7 ------------------------------------------------------------------------------
def learning_curve(model_type: str, df: DataFrame, features: list[str], label: str, key: str,
                   params: dict | None = None, cv: int = 5, sizes: int = 5, seed: int = 42,
                   parallelism: int = 4) -> DataFrame:
    """accuracy on growing training subsets (10 %..100 % of each training
    fold, nested md5-ordered prefixes), mean and population std over folds.
    All fits of a logistic curve advance in the same passes (``operators.many_models``)."""
    from vitalis.operators.prep import folds_by, stratified_folds

    fracs = [0.1 + i * (0.9 / (sizes - 1)) for i in range(sizes)] if sizes > 1 else [1.0]
    if model_type == "logreg":
        c = float((params or {}).get("C", 1.0))
        data = materialised(folds_by(_narrow(df, features, label, key, seed).withColumn("_lu", unit_hash(col(key), seed, "curve"))
                                     .drop(key), "_fold_u", "_tie", "label", cv), "curve-rows", "zstd")
        key = "_tie"
        return _curve(df.sparkSession, curve_rows(data, features, "label", key, "fold", "_lu", cv, fracs, c))
    data = stratified_folds(_prepare(df, features, label).withColumn(key, col(key)), key, "label", cv, seed)
    data = data.withColumn("_lu", unit_hash(col(key), seed, "curve")).cache()

    def acc(scored: DataFrame) -> float:
        r = scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
        return float(r or 0.0)

    def run(f):
        """All sizes of one fold: its training rows are ranked and counted once."""
        tr = hash_rank(data.where(F.col("fold") != f), [], "_lu", "_r", tie=key).cache()
        n_tr, out = tr.count(), []
        for frac in fracs:
            n_take = int(frac * n_tr)
            sub = tr.where(F.col("_r") <= n_take).drop("_r")
            m = fit(model_type, sub, features, "label", params or {}, key=key, seed=seed)
            out.append((f, frac, n_take, acc(predict(m, sub, features, key)),
                        acc(predict(m, data.where(F.col("fold") == f), features, key))))
        tr.unpersist()
        return out

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        rows = [r for part in pool.map(run, range(cv)) for r in part]
    data.unpersist()
    return _curve(df.sparkSession, rows)


def _curve(spark, rows) -> DataFrame:
    """Means and deviations over the folds."""
    res = spark.createDataFrame(rows, "fold int, frac double, n_train long, train_acc double, val_acc double")
    return res.groupBy("frac").agg(F.avg("n_train").alias("n_train"), F.avg("train_acc").alias("train_mean"),
                                   F.stddev_pop("train_acc").alias("train_std"), F.avg("val_acc").alias("val_mean"),
                                   F.stddev_pop("val_acc").alias("val_std")).orderBy("frac")


# --- F8 ------------------------------------------------------------------------------
def permutation_importance(model, test: DataFrame, features: list[str], label: str, key: str,
                           repeats: int = 5, seed: int = 42) -> DataFrame:
    """F8: mean accuracy drop when one feature's values are shuffled among the
    test rows, ``repeats`` shuffles per feature, sorted descending.

    ``model``: a fitted model, or a function that adds ``prediction`` to a table with the
    features (and keeps its other columns). The rows are ranked once, by a hash of the key.
    A repeat's shuffle is a keyed bijection of the ranks, so a row's donor is arithmetic, and
    one lookup by rank brings the donor's values of all features. A row then expands to one copy
    for each feature with that one value replaced (and one unchanged copy in all); one
    ``transform`` scores the copies, one aggregate counts what is right."""
    data = _prepare(test, features, label).select(col(key).alias("_id"), *map(col, features), "label")
    # from here on a row is known by its rank
    ranked = materialised(hash_rank(data.withColumn("_bu", unit_hash(F.col("_id"), seed, "perm-base")), [], "_bu", "_pos",
                                    tie="_id").drop("_bu", "_id").withColumn("_pos", F.col("_pos") - 1), "ranked")
    n = ranked.count()
    out = "feature string, importance double, std double"
    if not n:
        return test.sparkSession.createDataFrame([], out)
    width = len(features)
    shuffles = F.array(*[F.struct(F.lit(r).alias("rep"), permuted_rank(F.col("_pos"), n, seed, f"perm-{r}").alias("donor"))
                         for r in range(repeats)])
    rows = ranked.select("_pos", "label", *[col(f).alias(f"_x{i}") for i, f in enumerate(features)], F.explode(shuffles).alias("_s"))
    donors = ranked.select(F.col("_pos").alias("_at"), *[col(f).alias(f"_d{i}") for i, f in enumerate(features)])
    both = rows.join(donors, F.col("_s.donor") == F.col("_at"))

    table = _table_of(model, width) if n >= MANY_ROWS else None
    if table is not None:  # a forest of few cuts: no copies, a row looks its classes up
        from vitalis.operators.forest_bins import permuted_right

        held = test.sparkSession.sparkContext.broadcast(table[1])
        counts = both.where("label IS NOT NULL").select(
            "_s.rep", "label", *[f"_x{i}" for i in range(width)], *[f"_d{i}" for i in range(width)]).mapInArrow(
            permuted_right((table[0], held), width, width), "_f int, _rep int, n long, right long")
        right = counts.groupBy("_f", "_rep").agg((F.sum("right") / F.sum("n")).alias("acc"))
    else:
        right = _copies_right(model, both, features, width)
    right = materialised(right, "accuracies")  # a number for each feature and repeat
    base = right.where("_f = -1").select(F.col("acc").alias("base"))
    names = F.element_at(F.array(*map(F.lit, features)), F.col("_f") + 1)
    return (right.where("_f >= 0").crossJoin(base).groupBy(names.alias("feature"))
            .agg(F.avg(F.col("base") - F.col("acc")).alias("importance"), F.stddev_pop("acc").alias("std"))
            .orderBy(F.desc("importance"), "feature"))


def _table_of(model, width: int):
    """``decision_table`` of a pipeline that gathers the features and ends in a forest, else None."""
    from pyspark.ml.classification import RandomForestClassificationModel

    from vitalis.operators.forest_bins import decision_table

    last = model.stages[-1] if isinstance(model, PipelineModel) else None
    return decision_table(last, width) if isinstance(last, RandomForestClassificationModel) else None


def _copies_right(model, both: DataFrame, features: list[str], width: int) -> DataFrame:
    """(_f, _rep, acc): the share of right predictions over the changed copies of rows with their donors."""
    def copy(changed: int):
        return F.struct(F.lit(changed).alias("_f"), *[F.col(f"_d{i}" if i == changed else f"_x{i}").alias(f"_v{i}") for i in range(width)])

    copies = F.array(*[copy(j) for j in range(width)])
    copies = F.when(F.col("_s.rep") == 0, F.concat(copies, F.array(copy(-1)))).otherwise(copies)
    permuted = both.select(F.col("_pos").alias("_id"), "label", F.col("_s.rep").alias("_rep"), F.explode(copies).alias("_c")).select(
        "_id", "label", "_rep", "_c._f", *[F.col(f"_c._v{i}").alias(f) for i, f in enumerate(features)])
    if isinstance(model, KnnModel):
        scored = _knn_group_predict(model, permuted.withColumnsRenamed({"_f": "feature", "_rep": "rep"}), features, "_id") \
            .withColumnsRenamed({"feature": "_f", "rep": "_rep"})
    else:
        scored = model(permuted) if callable(model) else predict(model, permuted, features, "_id")
    return scored.groupBy("_f", "_rep").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("acc"))


def _knn_group_predict(model: KnnModel, permuted: DataFrame, features: list[str], key: str) -> DataFrame:
    ids = permuted.withColumn("_pid", F.concat_ws("|", col(key).cast("string"), F.col("feature"),
                                                  F.col("rep").cast("string")))
    out = model.predict(ids.drop(key), "_pid")
    return out
