"""Distribution functions in plain Python and numpy: normal, t, F, chi-square, studentized range."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()
_TINY = 1e-300


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def norm_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta, by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = c if abs(c) > _TINY else _TINY
            f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * f


def gammainc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma."""
    if x <= 0:
        return 0.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        for n in range(1, 2000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return lead * total
    b, c = x + 1 - a, 1 / _TINY
    d = 1 / b
    h = d
    for i in range(1, 2000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - lead * h


def t_two_sided(t: float, df: float) -> float:
    if math.isnan(t) or math.isnan(df):
        return math.nan
    return betainc(df / 2, 0.5, df / (df + t * t))


def t_cdf(t: float, df: float) -> float:
    half = t_two_sided(t, df) / 2
    return 1 - half if t > 0 else half


def f_sf(f: float, df1: float, df2: float) -> float:
    if math.isnan(f) or math.isnan(df2) or df2 <= 0 or df1 <= 0:
        return math.nan
    return 1.0 if f <= 0 else betainc(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def chi2_sf(x: float, df: float) -> float:
    return 1.0 if x <= 0 else 1 - gammainc(df / 2, x / 2)


def _quantile(cdf, p: float, lo: float, hi: float) -> float:
    while cdf(hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
        if hi - lo <= 1e-14 * max(1.0, abs(hi)):
            break
    return (lo + hi) / 2


def t_ppf(p: float, df: float) -> float:
    if df > 1e7:
        return norm_ppf(p)
    return -t_ppf(1 - p, df) if p < 0.5 else _quantile(lambda x: t_cdf(x, df), p, 0.0, 10.0)


def chi2_ppf(p: float, df: float) -> float:
    return _quantile(lambda x: 1 - chi2_sf(x, df), p, 0.0, 10.0)


@lru_cache(maxsize=8)
def _legendre(n: int):
    return np.polynomial.legendre.leggauss(n)


_erfc = np.vectorize(math.erfc, otypes=[float])


def _range_cdf(w: float, k: int) -> float:
    """Probability that the range of k standard normals is at most w."""
    if w <= 0:
        return 0.0
    x, g = _legendre(96)
    z = 8.5 * x
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    inner = 0.5 * _erfc(-z / math.sqrt(2)) - 0.5 * _erfc(-(z - w) / math.sqrt(2))
    return float(min(1.0, k * 8.5 * np.sum(g * phi * inner ** (k - 1))))


def tukey_sf(q: float, k: int, df: float = math.inf) -> float:
    """Upper tail of the studentized range of k means."""
    if math.isnan(q) or k < 2:
        return math.nan
    if math.isinf(df) or df > 25_000:
        return 1 - _range_cdf(q, k)
    # s = chi(df) / sqrt(df): integrate over its bulk.
    sd = 1 / math.sqrt(2 * df)
    lo, hi = max(0.0, 1 - 9 * sd), 1 + 9 * sd
    x, g = _legendre(48)
    s = (hi + lo) / 2 + (hi - lo) / 2 * x
    log_density = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(np.maximum(s, _TINY)) - df * s * s / 2
    total = np.sum(g * np.exp(log_density) * np.array([_range_cdf(q * v, k) for v in s])) * (hi - lo) / 2
    return float(min(1.0, max(0.0, 1 - total)))


def hermite_nodes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights of an expectation over a standard normal."""
    x, w = np.polynomial.hermite.hermgauss(n)
    return x * math.sqrt(2), w / math.sqrt(math.pi)
