"""Distribution functions evaluated inside Spark tasks.

Only the Student-t tail is needed (two-sided p of the pooled t-test). It is a
regularised incomplete beta: ``p = I_x(df/2, 1/2)`` with ``x = df/(df+t^2)``.
The continued fraction (modified Lentz) is written with numpy and applied by an
Arrow-batched pandas UDF on the one-row-per-feature result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _betacf(a: np.ndarray, b: np.ndarray, x: np.ndarray, iters: int = 300) -> np.ndarray:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < tiny, tiny, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, iters + 1):
        m2 = 2.0 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        delta = d * c
        h *= delta
        if np.all(np.abs(delta - 1.0) < 1e-15):
            break
    return h


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b), element-wise."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    out = np.full(np.broadcast(a, b, x).shape, np.nan)
    a, b, x = np.broadcast_arrays(a, b, x)
    ok = np.isfinite(a) & np.isfinite(b) & np.isfinite(x) & (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    lg = np.vectorize(math.lgamma)
    for sel, flip in ((ok & (x < (a + 1) / (a + b + 2)), False), (ok & ~(x < (a + 1) / (a + b + 2)), True)):
        if not np.any(sel):
            continue
        aa, bb, xx = a[sel], b[sel], x[sel]
        if flip:
            aa, bb, xx = bb, aa, 1.0 - xx
        with np.errstate(divide="ignore", invalid="ignore"):
            lbeta = lg(aa + bb) - lg(aa) - lg(bb)
            front = np.exp(lbeta + aa * np.log(xx) + bb * np.log1p(-xx)) / aa
            val = front * _betacf(aa, bb, xx)
        val = np.where(xx == 0, 0.0, val)
        out[sel] = 1.0 - val if flip else val
    return out


def student_t_two_sided(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    t = np.asarray(t, dtype=float)
    dof = np.asarray(dof, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = dof / (dof + t * t)
    p = betainc(dof / 2.0, np.full_like(dof, 0.5), x)
    return np.where(np.isfinite(t) & (dof > 0), p, np.nan)


@F.pandas_udf(T.DoubleType())
def _t_p_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    p = student_t_two_sided(t.to_numpy(dtype=float, na_value=np.nan), dof.to_numpy(dtype=float, na_value=np.nan))
    return pd.Series(p).where(~np.isnan(p), None)


def t_pvalue(t: Column, dof: Column) -> Column:
    """Two-sided Student-t p value as a Column (vectorised pandas UDF)."""
    return _t_p_udf(t.cast("double"), dof.cast("double"))
