"""Tails and quantiles of the usual distributions, for the small results that tests leave over.

Plain Python on math.erfc and math.lgamma: incomplete beta by its continued fraction, incomplete gamma by series and
continued fraction, quantiles by bisection, the studentized range by Gauss-Legendre quadrature.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f = 1.0, 0.0, 1.0
    for i in range(600):
        m = i // 2
        t = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + t * d or 1e-300)
        c = 1 + t / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-16:
            break
    return front * (f - 1)


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def chi2_tail(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def t_tail(t: float, df: float, alternative: str = "two-sided") -> float:
    two = beta_inc(df / 2, 0.5, df / (df + t * t))
    if alternative == "two-sided":
        return two
    upper = two / 2 if t >= 0 else 1 - two / 2
    return upper if alternative == "greater" else 1 - upper


def f_tail(f: float, df1: float, df2: float) -> float:
    return beta_inc(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def _invert(cdf, p: float, low: float, high: float) -> float:
    while cdf(low) > p:
        low *= 2
    while cdf(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def normal_quantile(p: float) -> float:
    return _invert(normal_cdf, p, -1.0, 1.0)


def t_quantile(p: float, df: float) -> float:
    return _invert(lambda t: 1 - t_tail(t, df, "greater"), p, -1.0, 1.0)


@lru_cache(maxsize=4)
def _nodes(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(n)


_erfc = np.vectorize(math.erfc, otypes=[float])


def _range_cdf(w: np.ndarray, k: int) -> np.ndarray:
    """Chance that the range of k standard normals is at most w."""
    x, weight = _nodes(96)
    z = 8.5 * x[:, None]
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    inside = 0.5 * (_erfc(-z / math.sqrt(2)) - _erfc(-(z - w[None, :]) / math.sqrt(2)))
    return k * 8.5 * (weight[:, None] * density * np.clip(inside, 0, 1) ** (k - 1)).sum(0)


def tukey_cdf(q: float, k: int, df: float) -> float:
    """Studentized range: the range over an independent chi / sqrt(df)."""
    if q <= 0:
        return 0.0
    if df > 25000:
        return float(_range_cdf(np.array([q]), k)[0])
    x, weight = _nodes(96)
    mode = math.sqrt(max(df - 1, 0.5) / df)
    wide = 8 / math.sqrt(2 * df)
    low, high = max(0.0, mode - wide), mode + wide
    s = (high - low) / 2 * x + (high + low) / 2
    log_density = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    return float(min(1.0, (high - low) / 2 * (weight * np.exp(log_density) * _range_cdf(q * s, k)).sum()))


def tukey_quantile(p: float, k: int, df: float) -> float:
    low, high = 0.0, 8.0
    while tukey_cdf(high, k, df) < p:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if tukey_cdf(mid, k, df) < p else (low, mid)
    return (low + high) / 2


@lru_cache(maxsize=50_000)
def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher p: tables at most as likely as the observed one, within 1e-7 relatively."""
    n, r, k = a + b + c + d, a + b, a + c
    base = math.lgamma(r + 1) + math.lgamma(n - r + 1) + math.lgamma(k + 1) + math.lgamma(n - k + 1) - math.lgamma(n + 1)
    x = np.arange(max(0, r + k - n), min(r, k) + 1)
    lg = np.vectorize(math.lgamma, otypes=[float])
    p = np.exp(base - lg(x + 1) - lg(r - x + 1) - lg(k - x + 1) - lg(n - r - k + x + 1))
    return float(min(1.0, p[p <= p[a - x[0]] * (1 + 1e-7)].sum()))
