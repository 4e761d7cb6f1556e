"""Tail functions of the t, beta, binomial and chi-squared laws, vectorised with numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


def _log_gamma(values):
    flat = np.ravel(values)
    return np.array([math.lgamma(v) for v in flat]).reshape(np.shape(values))


def beta_cdf(a, b, x):
    """Regularised incomplete beta function by its published continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    x = np.clip(x, 0.0, 1.0)
    mirrored = x > (a + 1.0) / (a + b + 2.0)
    p, q, z = np.where(mirrored, b, a), np.where(mirrored, a, b), np.where(mirrored, 1.0 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(
            _log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(z) + q * np.log1p(-z)
        ) / p
    front = np.where(z <= 0.0, 0.0, front)
    value = front * _beta_fraction(p, q, z)
    return np.where(mirrored, 1.0 - value, value)


def _beta_fraction(a, b, x):
    """Evaluate the fraction bottom-up from a depth that suffices for the mirrored range."""
    depth = 400
    tail = np.ones_like(x)
    for m in range(depth, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        tail = 1.0 + odd / (1.0 + even / tail)
    return 1.0 / tail


def t_two_sided(t, df):
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return beta_cdf(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p, df):
    """Value whose lower tail is ``p`` (p >= 0.5), by bisection."""
    p, df = np.broadcast_arrays(np.asarray(p, dtype=float), np.asarray(df, dtype=float))
    low, high = np.zeros(p.shape), np.full(p.shape, 1.0)
    target = 2.0 * (1.0 - p)
    for _ in range(60):
        high = np.where(t_two_sided(high, df) > target, high * 2.0, high)
    for _ in range(80):
        middle = 0.5 * (low + high)
        above = t_two_sided(middle, df) > target
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return 0.5 * (low + high)


def beta_quantile(p, a, b):
    p, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (p, a, b)))
    low, high = np.zeros(p.shape), np.ones(p.shape)
    for _ in range(80):
        middle = 0.5 * (low + high)
        below = beta_cdf(a, b, middle) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return 0.5 * (low + high)


def binomial_interval(successes, trials, level: float = 0.95):
    """Exact (Clopper-Pearson) interval for a proportion."""
    x, n = np.asarray(successes, dtype=float), np.asarray(trials, dtype=float)
    alpha = (1.0 - level) / 2.0
    low = np.where(x <= 0, 0.0, beta_quantile(alpha, np.maximum(x, 1e-12), n - x + 1.0))
    high = np.where(x >= n, 1.0, beta_quantile(1.0 - alpha, x + 1.0, np.maximum(n - x, 1e-12)))
    return low, high


def binomial_upper_tail(successes, trials, p):
    """P(X >= successes)."""
    x, n, p = (np.asarray(v, dtype=float) for v in (successes, trials, p))
    return np.where(x <= 0, 1.0, beta_cdf(np.maximum(x, 1e-12), n - x + 1.0, p))


def chi_squared_tail(statistic, df):
    """P(X >= statistic), through the regularised lower gamma series."""
    x, df = np.broadcast_arrays(np.asarray(statistic, dtype=float) / 2.0, np.asarray(df, dtype=float))
    a = df / 2.0
    with np.errstate(divide="ignore", invalid="ignore"):
        term = np.where(x > 0, np.exp(a * np.log(x) - x - _log_gamma(a + 1.0)), 0.0)
        total = term.copy()
        for i in range(1, 2000):
            term = term * x / (a + i)
            total = total + term
            if np.all(term <= 1e-17 * np.maximum(total, 1e-300)):
                break
    return np.clip(1.0 - total, 0.0, 1.0)


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(np.where(df > 0, t_two_sided(t, df.where(df > 0, 1.0)), np.nan)).where(t.notna())


@F.pandas_udf(T.DoubleType())
def t_quantile_975(df: pd.Series) -> pd.Series:
    known = df.where(df > 0, 1.0).fillna(1.0)
    return pd.Series(t_quantile(0.975, known)).where(df > 0)
