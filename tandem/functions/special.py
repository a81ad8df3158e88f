"""Distribution tails and quantiles in numpy, and the pandas functions that bring them to columns.

They run on the few rows that an aggregate leaves (one for each group and term),
so plain vector loops to convergence are enough.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_cdf(x, a, b) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    x, a, b = (np.array(v, float) for v in np.broadcast_arrays(x, a, b))
    swap = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    inside = (x > 0) & (x < 1)
    z = np.where(inside, x, 0.5)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(z) + b * np.log1p(-z)) / a
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1 - (a + b) * z / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 2000):
        for term in (m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    out = np.where(inside, front * h, np.where(x <= 0, 0.0, 1.0))
    return np.where(swap, 1 - out, out)


def _bisect(below, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where a rising predicate ``below`` turns from true to false, between low and high."""
    low, high = low.astype(float).copy(), high.astype(float).copy()
    for _ in range(200):
        middle = (low + high) / 2
        less = below(middle)
        low, high = np.where(less, middle, low), np.where(less, high, middle)
    return (low + high) / 2


def beta_quantile(q, a, b) -> np.ndarray:
    q, a, b = (np.array(v, float) for v in np.broadcast_arrays(q, a, b))
    return _bisect(lambda x: beta_cdf(x, a, b) < q, np.zeros_like(q), np.ones_like(q))


def t_two_sided(t, df) -> np.ndarray:
    """P(|T| >= |t|) of Student's t; 0 for an infinite t."""
    t, df = (np.array(v, float) for v in np.broadcast_arrays(t, df))
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.where(np.isinf(t), 0.0, df / (df + t * t))
    return beta_cdf(x, df / 2, 0.5)


def t_quantile(q, df) -> np.ndarray:
    """The upper quantile for q >= 0.5."""
    q, df = (np.array(v, float) for v in np.broadcast_arrays(q, df))
    x = beta_quantile(2 * (1 - q), df / 2, 0.5)
    return np.sqrt(df * (1 - x) / np.maximum(x, 1e-300))


def chi2_tail(x, k) -> np.ndarray:
    """P(X >= x) of a chi-square with k degrees of freedom (upper regularised gamma)."""
    out = []
    for x_, k_ in np.nditer(np.broadcast_arrays(np.array(x, float), np.array(k, float))):
        s, z = float(k_) / 2, float(x_) / 2
        if not z > 0:
            out.append(1.0 if z == 0 else math.nan)
            continue
        front = math.exp(s * math.log(z) - z - math.lgamma(s))
        if z < s + 1:
            term = total = 1 / s
            n = s
            while abs(term) > abs(total) * 1e-17:
                n += 1
                term *= z / n
                total += term
            out.append(1 - front * total)
        else:
            b, c, d = z + 1 - s, 1e300, 1 / (z + 1 - s)
            h = d
            for i in range(1, 10_000):
                a = -i * (i - s)
                b += 2
                d = 1 / (a * d + b or 1e-300)
                c = b + a / c or 1e-300
                h *= d * c
                if abs(d * c - 1) < 1e-16:
                    break
            out.append(front * h)
    return np.array(out).reshape(np.broadcast(x, k).shape)


def _column(f, *columns: Column) -> Column:
    """Rows with a null in any argument give null."""

    @F.pandas_udf("double")
    def run(*values: pd.Series) -> pd.Series:
        frame = pd.concat(values, axis=1).astype(float)
        good = frame.notna().all(axis=1)
        out = pd.Series(np.nan, frame.index, dtype=float).astype(object)
        out[:] = None
        if good.any():
            out[good] = f(*(frame.loc[good].iloc[:, i].to_numpy() for i in range(frame.shape[1])))
        return out.astype("Float64") if out.isna().any() else out.astype(float)

    return run(*(c.cast("double") for c in columns))


def t_pvalue(t: Column, df: Column) -> Column:
    return _column(t_two_sided, t, df)


def t_critical(confidence: float, df: Column) -> Column:
    return _column(lambda d: t_quantile(1 - (1 - confidence) / 2, d), df)


def beta_inverse(q: float, a: Column, b: Column) -> Column:
    return _column(lambda x, y: beta_quantile(q, x, y), a, b)


def chi2_pvalue(x: Column, k: Column) -> Column:
    return _column(chi2_tail, x, k)
