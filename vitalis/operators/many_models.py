"""Many logistic models in one scan.

Folds, training sizes and candidates of a search differ only in which rows they see and
in their penalty. Every model takes a Newton step from sums over its rows (loss,
gradient, Hessian), and one pass over the table adds these up for all models at once:
a row says by a bit mask which models it trains and which it tests. Partial sums are a few
numbers for each model and task, added up by one aggregate; the steps are solved on the
driver. After about eight passes all models have converged, however many there are.

The objective is that of the single fits: sum of log losses + 1 / (2 C) |w|^2, the
intercept free, C per model. A step that raises the loss is halved.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalis.functions.columns import as_double, col

MOST_MODELS = 62  # in a pass: the bits of a mask
Features = Callable[[np.ndarray], np.ndarray]  # of a block of rows, inside a task
DAMPING = (0.0, 1e-3, 1e-2, 1e-1, 1.0)  # with the last one a step cannot raise the loss
ROWS = 1 << 14
FEW = 12  # columns whose products are made once for all models
CURVED = 1_000_000  # rows whose products make a wide Hessian: it only steers the steps, loss and gradient are of all rows


@dataclass
class Linear:
    """One fitted model; z = intercept + coefficients . x, class 1 iff z > 0."""
    coefficients: np.ndarray
    intercept: float
    n: int
    passes: int
    converged: bool


def mask_of(conditions: list[Column]) -> Column:
    """The conditions as bits of a long; null counts as false."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(conditions):
        out = out.bitwiseOR(F.when(c, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def _blocks(batch, width, features: Features | None = None):
    """(mask, y, x) of a batch: the columns, or what ``features`` makes of them, and a one."""
    rows = ROWS if features is None else ROWS // 8  # wider rows
    for a in range(0, batch.num_rows, rows):
        part = batch.slice(a, rows)
        x = np.stack([part.column(2 + c).to_numpy(zero_copy_only=False).astype(np.float64) for c in range(width)], axis=1)
        if features is not None:
            x = features(x)
        yield (part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False).astype(np.float64),
               np.concatenate([x, np.ones((len(x), 1))], axis=1))


def _bits(mask: np.ndarray, models: list[int]) -> np.ndarray:
    return (mask[:, None] >> np.array(models)[None, :]) & 1


def _rows(models, total):
    m, i = np.meshgrid(models, np.arange(total.shape[1]), indexing="ij")
    return pa.RecordBatch.from_arrays([pa.array(m.reshape(-1), pa.int32()), pa.array(i.reshape(-1), pa.int32()),
                                       pa.array(total.reshape(-1))], ["model", "i", "v"])


def log_loss(z: np.ndarray, y: np.ndarray):
    """Loss, slope and curvature in z of the logistic loss."""
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return np.logaddexp(0, z) - y * z, p - y, p * (1 - p)


BEND = 0.5  # where the hinge is rounded off: margins from 1 - BEND to 1


def hinge_loss(z: np.ndarray, y: np.ndarray):
    """The same of the hinge loss, rounded off by a parabola below margin 1."""
    side = 2 * y - 1
    short = 1 - side * z
    flat, bent = short <= 0, short < BEND
    loss = np.where(flat, 0.0, np.where(bent, short * short / (2 * BEND), short - BEND / 2))
    return loss, -side * np.clip(short / BEND, 0.0, 1.0), np.where(bent & ~flat, 1 / BEND, 0.0)


def _sums(weights: dict[int, np.ndarray], width: int, losses, features: Features | None, most: float | None, thin: int = 1):
    """Per model: rows, loss, positives, gradient, upper half of the Hessian (with ``most`` as the curvature of every row).

    A wide Hessian is ``thin`` times that of about every ``thin``-th row of a block, picked from a fixed seed."""
    models = sorted(weights)
    w = np.stack([weights[m] for m in models], axis=1)
    size = len(w)
    upper = np.triu_indices(size)

    def run(batches):
        total, square = np.zeros((len(models), 3 + size)), np.zeros((len(models), size, size))
        flat = np.zeros((len(models), len(upper[0])))
        for batch in batches:
            for mask, y, x in _blocks(batch, width, features):
                of = _bits(mask, models).astype(float)
                loss, slope, bend = losses(x @ w, y[:, None])
                total[:, 0] += of.sum(axis=0)
                total[:, 1] += (of * loss).sum(axis=0)
                total[:, 2] += (of * (y == 1)[:, None]).sum(axis=0)
                total[:, 3:] += (x.T @ (of * slope)).T
                s = of * (bend if most is None else most)
                if size <= FEW:  # the products of two columns are the same for all models
                    flat += s.T @ (x[:, upper[0]] * x[:, upper[1]])
                    continue
                if thin > 1:
                    few = np.flatnonzero(np.random.default_rng(len(x)).random(len(x)) * thin < 1)
                    x, s = x[few], s[few] * thin
                for k in range(len(models)):
                    on = s[:, k] > 0  # rows beyond a bend have no curvature
                    part = x[on] * np.sqrt(s[on, k])[:, None]
                    square[k] += part.T @ part
        yield _rows(models, np.concatenate([total, flat + square[:, upper[0], upper[1]]], axis=1))
    return run


def _added(table: DataFrame, job, size: int) -> dict[int, np.ndarray]:
    """A job's partial sums of all tasks, model by model."""
    out: dict[int, np.ndarray] = {}
    for r in (table.mapInArrow(job, "model int, i int, v double").groupBy("model", "i").agg(F.sum("v").alias("v")).collect()):
        out.setdefault(r["model"], np.zeros(size))[r["i"]] = r["v"]
    return out


def as_table(df: DataFrame, features: list[str], label: str, train: Column, test: Column) -> DataFrame:
    """(mask, test, y, x0, x1, ...); a row without a label or with a missing feature ends the job with an error."""
    missing = F.raise_error(F.lit("a feature or the label is missing: fill or drop those rows before a fit"))
    return df.select(train.alias("mask"), test.alias("test"), F.coalesce(as_double(label), missing.cast("double")).alias("y"),
                     *[F.coalesce(as_double(f), missing.cast("double")).alias(f"x{c}") for c, f in enumerate(features)])


def fit_many(table: DataFrame, width: int, c: list[float], most_passes: int = 60, tolerance: float = 1e-10,
             losses=log_loss, features: Features | None = None, mapped: int | None = None,
             most_curvature: float | None = None, rows: int = 0) -> list[Linear]:
    """Model m trains on the rows with bit m of ``mask`` set, under penalty 1 / (2 c[m]).

    ``table``: (mask, y, x0, ...), read once a pass - hand in a written or cached one. ``losses``: logistic or hinge. A
    model whose rows have one class (or none) gets zero coefficients and an infinite (zero) intercept.
    ``features`` makes ``mapped`` columns of the ``width`` columns inside the tasks; they are never written.
    A loss whose curvature vanishes on some rows names its ``most_curvature``: the first pass takes it for every row,
    and a step that raises the loss is taken again with more and more of that Hessian added, not only halved.
    Of many more ``rows`` than ``CURVED`` a wide Hessian is estimated on about that many; the minimum is where the gradient of
    all rows vanishes, whatever Hessian led there.
    """
    thin = max(1, rows // CURVED)
    if len(c) > MOST_MODELS:
        return [m for a in range(0, len(c), MOST_MODELS) for m in fit_many(
            table.withColumn("mask", F.shiftright("mask", a)), width, c[a:a + MOST_MODELS], most_passes, tolerance, losses,
            features, mapped, most_curvature, rows)]
    raw, width = width, mapped or width
    upper = np.triu_indices(width + 1)
    size = 4 + width + len(upper[0])
    at = {m: np.zeros(width + 1) for m in range(len(c))}
    best = {m: (np.inf, None) for m in at}  # loss and weights of the last accepted step
    bound: dict[int, np.ndarray] = {}  # a Hessian that no other one exceeds
    held: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}  # gradient and Hessian of the last accepted step, its damping
    done: dict[int, Linear] = {}
    for turn in range(1, most_passes + 1):
        most = most_curvature if turn == 1 else None
        for m, s in _added(table, _sums(at, raw, losses, features, most, thin), size).items():
            w, n = at[m], int(s[0])
            gradient = s[3:4 + width].copy()
            if turn == 1 and s[2] in (0, n):
                done[m] = Linear(np.zeros(width), 0.0 if not n else np.inf if s[2] else -np.inf, n, 1, True)
                continue
            loss = s[1] + 0.5 / c[m] * (w[:-1] @ w[:-1])
            if loss > best[m][0] + 1e-9 * abs(best[m][0]):
                if m in held and held[m][2] + 1 < len(DAMPING):
                    gradient, hessian, level = held[m]
                    held[m] = gradient, hessian, level + 1
                    at[m] = best[m][1] - np.linalg.lstsq(hessian + DAMPING[level + 1] * bound[m], gradient, rcond=None)[0]
                else:
                    at[m] = (w + best[m][1]) / 2
                continue
            gradient[:-1] += w[:-1] / c[m]
            hessian = np.zeros((width + 1, width + 1))
            hessian[upper] = s[4 + width:]
            hessian = hessian + np.triu(hessian, 1).T
            hessian[np.arange(width), np.arange(width)] += 1 / c[m]
            if most is not None:
                bound[m] = hessian
            level = 0
            if most_curvature is not None:
                level = max(0, held[m][2] - 1) if m in held else 0
                held[m] = gradient, hessian, level
            full = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            step = np.linalg.lstsq(hessian + DAMPING[level] * bound[m], gradient, rcond=None)[0] if level else full
            best[m] = loss, w
            small = gradient @ full <= tolerance * max(1.0, abs(loss))
            if most_curvature is not None:  # no curvature, no step: small by the bound as well
                small &= most is None and gradient @ np.linalg.lstsq(bound[m], gradient, rcond=None)[0] <= tolerance * max(1.0, abs(loss))
            if small:
                done[m] = Linear((w - full)[:-1], float((w - full)[-1]), n, turn, True)
            else:
                at[m] = w - step
        at = {m: w for m, w in at.items() if m not in done}
        if not at:
            break
    for m, w in at.items():
        done[m] = Linear(w[:-1], float(w[-1]), 0, most_passes, False)
    return [done[m] for m in range(len(c))]


def _judged(models: list[Linear], width: int):
    """Per model: rows, correct, positives, true positives among the rows of its bit."""
    w = np.stack([np.append(m.coefficients, m.intercept) for m in models], axis=1)
    every = list(range(len(models)))

    def run(batches):
        total = np.zeros((len(models), 4))
        for batch in batches:
            for mask, y, x in _blocks(batch, width):
                of = _bits(mask, every).astype(bool)
                says, is_one = x[:, :-1] @ w[:-1] + w[-1] > 0, (y == 1)[:, None]
                for k, hit in enumerate((of, of & (says == is_one), of & is_one, of & is_one & says)):
                    total[:, k] += hit.sum(axis=0)
        yield _rows(every, total)
    return run


def judge_many(table: DataFrame, width: int, models: list[Linear]) -> list[tuple[int, int, int, int]]:
    """(rows, correct, positives, true positives) of every model on the rows with its bit set, in one pass."""
    if len(models) > MOST_MODELS:
        return [r for a in range(0, len(models), MOST_MODELS) for r in judge_many(
            table.withColumn("mask", F.shiftright("mask", a)), width, models[a:a + MOST_MODELS])]
    sums = _added(table, _judged(models, width), 4)
    return [tuple(int(v) for v in sums.get(m, np.zeros(4))) for m in range(len(models))]


def _margins(models: list[Linear], width: int, features: Features | None):
    """(margin by the model of the row's bit, y) of every row with a bit."""
    w = np.stack([np.append(m.coefficients, m.intercept) for m in models], axis=1)

    def run(batches):
        for batch in batches:
            for mask, y, x in _blocks(batch, width, features):
                of = _bits(mask, list(range(len(models)))).astype(bool)
                use = of.any(axis=1)
                margin = (x[use] @ w)[np.arange(use.sum()), of[use].argmax(axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(margin), pa.array(y[use])], ["margin", "y"])
    return run


def _calibration(a: float, b: float, high: float, low: float):
    """Sums for one Newton step of Platt's sigmoid over (margin, y)."""
    def run(batches):
        total = np.zeros((1, 6))
        for batch in batches:
            margin, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            goal = np.where(y == 1, high, low)
            z = a * margin + b
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            bend = p * (1 - p)
            total[0] += [(np.logaddexp(0, z) - goal * z).sum(), ((p - goal) * margin).sum(), (p - goal).sum(),
                         (bend * margin * margin).sum(), (bend * margin).sum(), bend.sum()]
        yield _rows([0], total)
    return run


def platt(table: DataFrame, width: int, models: list[Linear], positives: int, negatives: int,
          most_passes: int = 100, features: Features | None = None) -> tuple[float, float]:
    """(a, b) of P(class 1) = 1 / (1 + exp(-(a margin + b))), fitted on every row's margin by the model of its bit,
    to Platt's smoothed targets; a Newton step that raises the loss is halved. The margins are worked out once and written."""
    from vitalis.session import materialised

    high, low = (positives + 1) / (positives + 2), 1 / (negatives + 2)
    margins = materialised(table.mapInArrow(_margins(models, width, features), "margin double, y double"), "margins")
    at, best = np.array([0.0, np.log((positives + 1) / (negatives + 1))]), (np.inf, None)
    for _ in range(most_passes):
        s = _added(margins, _calibration(at[0], at[1], high, low), 6).get(0, np.zeros(6))
        if s[0] > best[0] + 1e-9 * abs(best[0]):
            at = (at + best[1]) / 2
            continue
        best = s[0], at
        step = np.linalg.lstsq(np.array([[s[3] + 1e-12, s[4]], [s[4], s[5] + 1e-12]]), s[1:3], rcond=None)[0]
        if abs(s[1:3] @ step) <= 1e-10 * max(1.0, abs(s[0])):
            break
        at = at - step
    return float(at[0]), float(at[1])


def curve_rows(df: DataFrame, features: list[str], label: str, key: str, fold: str, u: str, cv: int, fractions: list[float],
               c: float) -> list[tuple[int, float, int, float, float]]:
    """(fold, fraction, rows, training accuracy, validation accuracy) of every fold and size of a learning curve.

    A size is the rows of the training folds with the smallest (``u``, ``key``). No row is ranked: where a size
    ends is found by counting, and rows are compared with it - hand in a written or cached table.
    """
    from vitalis.functions.ranking import prefix_sums, rank_cuts
    from vitalis.session import materialised

    if cv * len(fractions) > MOST_MODELS:
        raise ValueError(f"at most {MOST_MODELS} fits in one curve")
    sets = [col(fold) != f for f in range(cv)]
    sizes, cuts = rank_cuts(df, sets, u, key, lambda n: [[int(share * n[f]) for share in fractions] for f in range(cv)])
    specs = [(f, share, int(share * sizes[f])) for f in range(cv) for share in fractions]
    test = mask_of([col(fold) == f for f, _, _ in specs])
    if cuts is not None:
        train = mask_of([sets[f] & cut.holds(col(u), col(key)) for f in range(cv) for cut in cuts[f]])
        ranked = df
    else:  # a size ends between rows of one key: all folds' ranks from one prefix pass with a weight for each fold
        ranked = prefix_sums(df.select(col(key), col(label), *map(col, features), col(fold), col(u),
                                       *[s.cast("long").alias(f"_w{f}") for f, s in enumerate(sets)]),
                             [], u, [f"_w{f}" for f in range(cv)], uniform_unit=True, tie=key)
        train = mask_of([(col(fold) != f) & (F.col(f"_w{f}_before") < take) for f, _, take in specs])
    table = materialised(as_table(ranked, features, label, train, test), "curve", "zstd")
    xs = [f"x{i}" for i in range(len(features))]
    fitted = fit_many(table.select("mask", "y", *xs), len(features), [c] * len(specs))
    seen = judge_many(table.select("mask", "y", *xs), len(features), fitted)
    fresh = judge_many(table.select(F.col("test").alias("mask"), "y", *xs), len(features), fitted)
    return [(f, share, take, a[1] / a[0] if a[0] else 0.0, b[1] / b[0] if b[0] else 0.0)
            for (f, share, take), a, b in zip(specs, seen, fresh, strict=True)]
