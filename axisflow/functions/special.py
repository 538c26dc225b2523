"""Log-factorials, hypergeometric tail and Student-t tail as Spark columns (no scipy)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients (g = 7, n = 9).
LANCZOS_G = 7.0
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
HALF_LOG_2PI = 0.9189385332046727


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 0.5."""
    z = x - F.lit(1.0)
    a = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        a = a + F.lit(c) / (z + F.lit(float(i)))
    t = z + F.lit(LANCZOS_G + 0.5)
    return F.lit(HALF_LOG_2PI) + (z + F.lit(0.5)) * F.log(t) - t + F.log(a)


def log_choose(n: Column, k: Column) -> Column:
    one = F.lit(1.0)
    return log_gamma(n + one) - log_gamma(k + one) - log_gamma(n - k + one)


def hypergeometric_tail(hits: Column, drawn: Column, good: Column, total: Column) -> Column:
    """P(X >= hits) for ``drawn`` items out of ``total`` of which ``good`` are marked.

    One log-probability starts the sum and the rest follow from the ratio of neighbouring terms. The sum runs
    away from the mean (upward above it, downward and subtracted from 1 below it), so it stays below a few units.
    """
    h, d, g, n = (c.cast("double") for c in (hits, drawn, good, total))
    lowest = F.greatest(F.lit(0.0), d + g - n)
    top = F.least(d, g)

    def log_p(x: Column) -> Column:
        return log_choose(g, x) + log_choose(n - g, d - x) - log_choose(n, d)

    def run(steps: Column, start: Column, ratio) -> Column:
        zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

        def step(acc, i):
            term = acc["term"] * ratio(start, i.cast("double"))
            return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))
        return F.aggregate(steps, zero, step, lambda acc: acc["total"])
    none = F.array().cast("array<int>")
    count = lambda c: F.when(c >= 1, F.sequence(F.lit(1), c.cast("int"))).otherwise(none)
    up = run(count(top - h), h, lambda s, i: (g - (s + i - 1)) * (d - (s + i - 1)) / ((s + i) * (n - g - d + s + i)))
    s0 = h - 1
    down = run(count(s0 - lowest), s0, lambda s, i: (s - i + 1) * (n - g - d + s - i + 1) / ((g - (s - i)) * (d - (s - i))))
    upper = F.when(h > top, 0.0).otherwise(F.exp(log_p(F.least(h, top))) * up)
    lower = 1.0 - F.exp(log_p(F.greatest(s0, lowest))) * down
    tail = F.when(h <= lowest, 1.0).when(h >= d * g / n, upper).otherwise(lower)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail))


_TINY, _LARGE = 1e-300, 100.0


def _log_beta_half(a: np.ndarray) -> np.ndarray:
    """ln B(a, 1/2); above ``_LARGE`` by the series of the ratio of gammas, which does not cancel."""
    some, back = np.unique(a, return_inverse=True)
    near = np.array([math.lgamma(v) - math.lgamma(v + 0.5) if 0 < v <= _LARGE else np.nan for v in some])[back]
    ratio = -0.5 * np.log(a) + 1 / (8 * a) - 1 / (192 * a ** 3) + 1 / (640 * a ** 5)
    return 0.5 * math.log(math.pi) + np.where(a <= _LARGE, near, ratio)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function by Lentz's rule; only values that still change go on."""
    out = np.full(len(x), np.nan)
    rows = np.flatnonzero(np.isfinite(x) & (a > 0) & (b > 0))
    a, b, x = a[rows], b[rows], x[rows]
    kept = lambda z: np.where(np.abs(z) < _TINY, _TINY, z)
    c, d = np.ones(len(x)), 1.0 / kept(1.0 - (a + b) * x / (a + 1.0))
    h, m = d.copy(), 0
    while len(rows):
        m += 1
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1.0 / kept(1.0 + even * d), kept(1.0 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1.0 / kept(1.0 + odd * d), kept(1.0 + odd / c)
        h = h * d * c
        done = np.abs(d * c - 1.0) < 1e-15
        done |= m > 100_000
        if done.any():
            out[rows[done]] = h[done]
            rows, a, b, x, c, d, h = (z[~done] for z in (rows, a, b, x, c, d, h))
    return out


def _t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|), the incomplete beta function of df / (df + t^2) with a = df / 2 and b = 1/2."""
    with np.errstate(all="ignore"):
        a, u = 0.5 * df, t * t / df
        x, y = 1.0 / (1.0 + u), np.where(np.isinf(u), 1.0, u / (1.0 + u))
        front = np.exp(-a * np.log1p(u) + 0.5 * np.log(y) - _log_beta_half(a))
        half = np.full(len(a), 0.5)
        other = x > (a + 1.0) / (a + 2.5)
        fraction = _beta_fraction(np.where(other, half, a), np.where(other, a, half), np.where(other, y, x))
        p = np.where(other, 1.0 - front * fraction / half, front * fraction / a)
    return np.clip(np.where(np.isnan(p), 1.0, p), 0.0, 1.0)


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided tail of Student's t, a batch at a time: some twenty steps of a continued fraction a row."""
    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(_t_tail(t.to_numpy(dtype=float), df.to_numpy(dtype=float)))
    t, df = t.cast("double"), df.cast("double")
    return F.when(t.isNotNull() & df.isNotNull(), tail(t, df))
