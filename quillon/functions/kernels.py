"""Tail probabilities on the log scale and combinations of p-values, in numpy, and as Arrow-batched column functions.

Log-gamma by Stirling's series; the incomplete beta function by its continued fraction (modified Lentz); the normal tail
by erfc with its asymptotic series far out; the normal quantile of a log probability by Newton's method.
"""

from __future__ import annotations

from math import erfc, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = log(2.0)


def lgamma(x: np.ndarray) -> np.ndarray:
    """For positive x."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(9):
        small = y < 9
        shift = shift + np.where(small, np.log(np.where(small, y, 1.0)), 0.0)
        y = np.where(small, y + 1, y)
    r = 1 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * log(2 * pi) + series - shift


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 400) -> np.ndarray:
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, rounds + 1):
        step = np.ones_like(x)
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + k / np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return h


def log1mexp(x: np.ndarray) -> np.ndarray:
    """log(1 - e^x) for x <= 0."""
    x = np.minimum(x, 0.0)
    with np.errstate(divide="ignore"):
        return np.where(x > -LN2, np.log(-np.expm1(x)), np.log1p(-np.exp(x)))


def log_beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """log of the regularised incomplete beta function."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    inside = (y > 0) & (y < 1)
    z = np.where(inside, y, 0.5)
    with np.errstate(divide="ignore"):
        out = p * np.log(z) + q * np.log1p(-z) - (lgamma(p) + lgamma(q) - lgamma(p + q)) - np.log(p) + np.log(_beta_fraction(p, q, z))
    out = np.where(inside, np.minimum(out, 0.0), np.where(y <= 0, -np.inf, 0.0))
    return np.where(flip, log1mexp(out), out)


def log_pt(t: np.ndarray, df: np.ndarray, upper: bool = False) -> np.ndarray:
    """log P(T <= t), or of T > t, for Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    if upper:
        t = -t
    tail = log_beta_inc(df / 2, np.full_like(df, 0.5), df / (df + t * t)) - LN2
    return np.where(t < 0, tail, log1mexp(tail))


def log_pbinom(k: np.ndarray, n: np.ndarray, p: np.ndarray, upper: bool = False) -> np.ndarray:
    """log P(X <= k), or of X >= k, for a binomial X of n draws."""
    k, n, p = (np.asarray(v, float) for v in np.broadcast_arrays(k, n, p))
    sure = k <= 0 if upper else k >= n
    a, b, x = (k, n - k + 1, p) if upper else (n - k, k + 1, 1 - p)
    return np.where(sure, 0.0, log_beta_inc(np.where(sure, 1.0, a), np.where(sure, 1.0, b), np.where(sure, 0.5, x)))


_ERFC = np.frompyfunc(erfc, 1, 1)


def log_pnorm(z: np.ndarray, upper: bool = False) -> np.ndarray:
    """log of the normal distribution function, or of its upper tail."""
    z = -np.asarray(z, float) if upper else np.asarray(z, float)
    near = np.maximum(z, -30.0)
    out = np.log(0.5 * _ERFC(-near / sqrt(2)).astype(float))
    far = z < -30
    if np.any(far):
        r = 1 / np.square(np.where(far, z, -30.0))
        out = np.where(far, -0.5 * z * z - np.log(-np.where(far, z, -1.0)) - 0.5 * log(2 * pi) + np.log1p(-r * (1 - 3 * r * (1 - 5 * r))), out)
    return out


def log_qnorm(lp: np.ndarray) -> np.ndarray:
    """z with log_pnorm(z) = lp."""
    lp = np.asarray(lp, float)
    high = lp > -LN2
    low = np.where(high, log1mexp(lp), lp)
    with np.errstate(invalid="ignore"):
        z = -np.sqrt(np.maximum(-2 * low - np.log(np.maximum(-4 * pi * low, 1.0)), 0.0))
        for _ in range(30):
            f = log_pnorm(z)
            step = (f - low) * np.exp(f + 0.5 * z * z + 0.5 * log(2 * pi))
            z = z - np.clip(np.nan_to_num(step), -2, 2)
    z = np.where(np.isneginf(low), -np.inf, z)
    return np.where(high, -z, z)


def fisher(log_sum: np.ndarray, k: np.ndarray) -> np.ndarray:
    """log p of Fisher's method from the sum of k log p-values."""
    x, k = -np.asarray(log_sum, float), np.asarray(k)
    term, total = np.zeros_like(x), np.zeros_like(x)
    with np.errstate(divide="ignore"):
        for i in range(1, int(k.max(initial=1))):
            term = term + np.log(x) - log(i)
            total = np.where(i < k, np.logaddexp(total, term), total)
    return np.minimum(total - x, 0.0)


def simes(log_p: np.ndarray) -> float:
    p = np.sort(log_p)
    return float(np.min(p + np.log(len(p) / np.arange(1, len(p) + 1))))


def _distinct(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of some columns: one place of each distinct row, and which of these each row is."""
    code = np.zeros(len(values[0]), np.int64)
    for v in values:
        levels, own = np.unique(v, return_inverse=True)
        _, first, code = np.unique(code * len(levels) + own, return_index=True, return_inverse=True)
    return first, code


def _series(f, *args: pd.Series) -> pd.Series:
    """f of the rows without nulls, once for equal rows (tests of counts have few different ones); null elsewhere."""
    ok = np.logical_and.reduce([a.notna().to_numpy() for a in args])
    out = np.full(len(ok), np.nan)
    if ok.any():
        values = [a.to_numpy(dtype=float, na_value=np.nan)[ok] for a in args]
        first, place = _distinct(values)
        out[ok] = f(*(v[first] for v in values))[place]
    return pd.Series(out).astype("Float64").where(ok, pd.NA)


def _column(f):
    @F.pandas_udf("double")
    def one(a: pd.Series) -> pd.Series:
        return _series(f, a)

    @F.pandas_udf("double")
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return _series(f, a, b)

    @F.pandas_udf("double")
    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return _series(f, a, b, c)

    return lambda *cols: (one, two, three)[len(cols) - 1](*(c.cast("double") if isinstance(c, Column) else c for c in cols))


def t_tails(left: Column, right: Column | None, df: Column) -> Column:
    """A struct of log P(T <= left) and log P(T > right); with right None both are of the same value, at the cost of one."""

    def both(t: pd.Series, u: pd.Series | None, df: pd.Series) -> pd.DataFrame:
        a, d = t.to_numpy(dtype=float, na_value=np.nan), df.to_numpy(dtype=float, na_value=np.nan)
        b = a if u is None else u.to_numpy(dtype=float, na_value=np.nan)
        ok = np.isfinite(a) & np.isfinite(b) & (d > 0)
        lo, hi = np.full(len(a), np.nan), np.full(len(a), np.nan)
        if ok.any() and u is None:
            x, k = a[ok], d[ok]
            tail = log_beta_inc(k / 2, np.full_like(k, 0.5), k / (k + x * x)) - LN2
            rest = log1mexp(tail)
            lo[ok], hi[ok] = np.where(x < 0, tail, rest), np.where(x < 0, rest, tail)
        elif ok.any():
            lo[ok], hi[ok] = log_pt(a[ok], d[ok]), log_pt(b[ok], d[ok], upper=True)
        return pd.DataFrame({c: pd.Series(v).astype("Float64").where(ok, pd.NA) for c, v in (("left", lo), ("right", hi))})

    if right is None:

        @F.pandas_udf("left double, right double")
        def one(t: pd.Series, df: pd.Series) -> pd.DataFrame:
            return both(t, None, df)

        return one(left, df)

    @F.pandas_udf("left double, right double")
    def two(t: pd.Series, u: pd.Series, df: pd.Series) -> pd.DataFrame:
        return both(t, u, df)

    return two(left, right, df)


def t_left(t: Column, df: Column) -> Column:
    return _column(lambda a, b: log_pt(a, b))(t, df)


def t_right(t: Column, df: Column) -> Column:
    return _column(lambda a, b: log_pt(a, b, upper=True))(t, df)


def binom_left(k: Column, n: Column, p: Column) -> Column:
    return _column(lambda a, b, c: log_pbinom(a, b, c))(k, n, p)


def binom_right(k: Column, n: Column, p: Column) -> Column:
    return _column(lambda a, b, c: log_pbinom(a, b, c, upper=True))(k, n, p)


def normal_left(z: Column) -> Column:
    return _column(lambda a: log_pnorm(a))(z)


def normal_right(z: Column) -> Column:
    return _column(lambda a: log_pnorm(a, upper=True))(z)


def normal_quantile(lp: Column) -> Column:
    return _column(log_qnorm)(lp)


def fisher_log_p(log_sum: Column, k: Column) -> Column:
    return _column(fisher)(log_sum, k)
