"""Student-t tail areas and quantiles for already aggregated rows.

Spark has no t distribution. These Arrow UDFs run on one row per reported cell,
never on observations.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _log_beta(a, b):
    lg = np.vectorize(math.lgamma, otypes=[float])
    return lg(a) + lg(b) - lg(a + b)


def _incomplete_beta(a, b, x):
    """Regularised incomplete beta by the modified Lentz continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                    -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    with np.errstate(divide="ignore"):
        front = np.exp(p * np.log(z) + q * np.log1p(-z) - _log_beta(p, q)) / p
    area = np.where(z <= 0, 0.0, front * h)
    return np.where(flip, 1 - area, area)


def upper_tail(t, df):
    """P(T > t) with ``df`` degrees of freedom."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    half = 0.5 * _incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return np.where(t >= 0, half, 1 - half)


def quantile(p, df):
    """Inverse of the distribution function, by bisection on the upper tail."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    target = np.minimum(p, 1 - p)
    lo, hi = np.zeros_like(target), np.ones_like(target)
    for _ in range(1100):
        grow = upper_tail(hi, df) > target
        if not grow.any():
            break
        hi = np.where(grow, hi * 2, hi)
    for _ in range(120):
        mid = (lo + hi) / 2
        above = upper_tail(mid, df) > target
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return np.where(p >= 0.5, 1, -1) * (lo + hi) / 2


def normal_upper_tail(z):
    return np.vectorize(lambda v: 0.5 * math.erfc(v / math.sqrt(2)), otypes=[float])(np.asarray(z, float))


def _masked(fn, *series):
    frame = pd.concat([s.astype(float) for s in series], axis=1)
    ok = np.isfinite(frame.to_numpy()).all(axis=1) & (frame.iloc[:, 1].to_numpy() > 0)
    out = pd.Series([None] * len(frame), dtype=object)
    if ok.any():
        cols = [frame.iloc[:, i].to_numpy()[ok] for i in range(frame.shape[1])]
        out[ok] = fn(*cols)
    return out.astype(float)


@F.pandas_udf(DoubleType())
def _sf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _masked(upper_tail, t, df)


@F.pandas_udf(DoubleType())
def _ppf(p: pd.Series, df: pd.Series) -> pd.Series:
    return _masked(quantile, p, df)


def _nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def t_upper(t: Column, df: Column) -> Column:
    return _nan_to_null(_sf(t.cast("double"), df.cast("double")))


def t_critical(confidence: float, df: Column) -> Column:
    return _nan_to_null(_ppf(F.lit((1 + confidence) / 2), df.cast("double")))


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    ok = np.isfinite(z.to_numpy(float))
    out = np.full(len(z), np.nan)
    out[ok] = 2 * normal_upper_tail(np.abs(z.to_numpy(float)[ok]))
    return pd.Series(out)
