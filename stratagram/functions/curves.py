"""Mean curves of nonlinear models: value and gradient, on numpy arrays and on columns."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

import numpy as np
from pyspark.sql import functions as F


class _N:
    exp, log = staticmethod(np.exp), staticmethod(lambda x: np.log(np.where(x > 0, x, np.nan)))
    pow = staticmethod(lambda a, b: np.where(a > 0, np.power(np.where(a > 0, a, 1.0), b), np.nan))
    where = staticmethod(np.where)


class _C:
    exp, pow = staticmethod(F.exp), staticmethod(F.pow)
    log = staticmethod(F.log)
    where = staticmethod(lambda c, a, b: F.when(c, a).otherwise(b))


NUMPY, COLUMNS = _N, _C


def _logis(x, p, m):
    a, mid, s = p
    e = m.exp((mid - x) / s)
    d = 1.0 + e
    return a / d, (1.0 / d, -a * e / (d * d) / s, a * e / (d * d) * (mid - x) / (s * s))


def _asymp(x, p, m):
    a, r, l = p  # noqa: E741
    k = m.exp(l)
    e = m.exp(-k * x)
    return a - (a - r) * e, (1.0 - e, e, (a - r) * e * k * x)


def _micmen(x, p, m):
    v, k = p
    return v * x / (k + x), (x / (k + x), -v * x / ((k + x) * (k + x)))


def _gompertz(x, p, m):
    a, b2, b3 = p
    w = m.exp(x * m.log(b3))
    t = m.exp(-b2 * w)
    return a * t, (t, -a * t * w, -a * t * b2 * x * w / b3)


def _power(x, p, m):
    a, b, c = p
    w = m.pow(x, b)
    return a * w + c, (w, a * w * m.log(x), x * 0.0 + 1.0)


def _fpl(x, p, m):
    a, b, mid, s = p
    e = m.exp((mid - x) / s)
    f = 1.0 / (1.0 + e)
    return a + (b - a) * f, (1.0 - f, f, -(b - a) * f * f * e / s, (b - a) * f * f * e * (mid - x) / (s * s))


def _biexp(x, p, m):
    a1, l1, a2, l2 = p
    k1, k2 = m.exp(l1), m.exp(l2)
    e1, e2 = m.exp(-k1 * x), m.exp(-k2 * x)
    return a1 * e1 + a2 * e2, (e1, -a1 * e1 * k1 * x, e2, -a2 * e2 * k2 * x)


def _weibull(x, p, m):
    a, d, l, w = p  # noqa: E741
    xp = m.where(x > 0, m.pow(m.where(x > 0, x, x * 0.0 + 1.0), w), x * 0.0)
    k = m.exp(l)
    e = m.exp(-k * xp)
    lx = m.where(x > 0, m.log(m.where(x > 0, x, x * 0.0 + 1.0)), x * 0.0)
    return a - d * e, (x * 0.0 + 1.0, -e, d * e * k * xp, d * e * k * xp * lx)


def _asymp_off(x, p, m):
    a, l, c = p  # noqa: E741
    k = m.exp(l)
    e = m.exp(-k * (x - c))
    return a * (1.0 - e), (1.0 - e, a * e * k * (x - c), -a * e * k)


def _asymp_orig(x, p, m):
    a, l = p  # noqa: E741
    k = m.exp(l)
    e = m.exp(-k * x)
    return a * (1.0 - e), (1.0 - e, a * e * k * x)


# ------------------------------------------------------------ starting values


def sorted_xy(x, y):
    """Sorted distinct x with the mean y at each."""
    ux, where = np.unique(np.asarray(x, float), return_inverse=True)
    return ux, np.bincount(where, y) / np.bincount(where)


def x_at(ux, uy, value):
    """Where the mean curve first passes ``value``, by linear interpolation."""
    for i in range(len(ux) - 1):
        lo, hi = sorted((uy[i], uy[i + 1]))
        if lo <= value <= hi and hi > lo:
            return ux[i] + (value - uy[i]) / (uy[i + 1] - uy[i]) * (ux[i + 1] - ux[i])
    return float(np.median(ux))


def _line(u, v):
    """Intercept and slope of v on u."""
    u, v = np.asarray(u, float), np.asarray(v, float)
    s = ((u - u.mean()) ** 2).sum()
    b = ((u - u.mean()) * (v - v.mean())).sum() / s if s > 0 else 0.0
    return v.mean() - b * u.mean(), b


def _rate(ux, uy, top):
    """log rate of approach to ``top``."""
    ok = np.abs(top - uy) > 1e-3 * (np.ptp(uy) or 1.0)
    return np.log(max(1e-6, -_line(ux[ok], np.log(np.abs(top - uy[ok])))[1])) if ok.sum() > 1 else -1.0


def _top(ux, uy):
    return uy.max() + 0.05 * np.ptp(uy) if uy[-1] >= uy[0] else uy.min() - 0.05 * np.ptp(uy)


def _start_logis(ux, uy):
    a = uy.max() * 1.05
    z = np.clip(uy / a, 1e-3, 1 - 1e-3)
    i, b = _line(ux, np.log(z / (1 - z)))
    return [a, -i / b if b else float(np.median(ux)), 1 / b if b else float(np.ptp(ux) or 1)]


def _start_gompertz(ux, uy):
    a = uy.max() * 1.05
    i, b = _line(ux, np.log(-np.log(np.clip(uy / a, 1e-3, 1 - 1e-3))))
    return [a, np.exp(i), np.exp(b)]


def _start_power(ux, uy):
    c = uy.min() - 0.1 * np.ptp(uy)
    ok = ux > 0
    i, b = _line(np.log(ux[ok]), np.log(uy[ok] - c + 1e-9))
    return [np.exp(i), b, c]


def _start_micmen(ux, uy):
    ok = (ux > 0) & (uy > 0)
    i, b = _line(1 / ux[ok], 1 / uy[ok])
    return [1 / i if i > 0 else uy.max() * 1.2, max(b / i, 1e-6) if i > 0 else float(np.median(ux))]


def _start_fpl(ux, uy):
    a, b = (uy[0], uy[-1])
    return [a, b, x_at(ux, uy, (a + b) / 2), float(np.ptp(ux) or 1) / 8]


def _start_biexp(ux, uy):
    n = max(2, len(ux) // 2)
    i2, b2 = _line(ux[n:], np.log(np.maximum(uy[n:], 1e-9)))
    a2, k2 = np.exp(i2), max(-b2, 1e-4)
    rest = np.maximum(uy[:n] - a2 * np.exp(-k2 * ux[:n]), 1e-3 * uy.max())
    i1, b1 = _line(ux[:n], np.log(rest))
    return [np.exp(i1), np.log(max(-b1, 2 * k2)), a2, np.log(k2)]


def _start_weibull(ux, uy):
    a = _top(ux, uy)
    d = a - uy[0] if a != uy[0] else 1.0
    ok = (ux > 0) & ((a - uy) / d > 1e-3) & ((a - uy) / d < 1 - 1e-3)
    i, b = _line(np.log(ux[ok]), np.log(-np.log((a - uy[ok]) / d))) if ok.sum() > 1 else (-1.0, 1.0)
    return [a, d, i, b]


@dataclass(frozen=True)
class Curve:
    """``mean(x, parameters, numpy or columns)`` -> value, gradient by parameter."""

    name: str
    parameters: tuple
    mean: Callable
    start: Callable

    def values(self, x, params):
        """Value and gradient, arrays; params broadcast against x."""
        with np.errstate(all="ignore"):
            v, g = self.mean(np.asarray(x, float), params, NUMPY)
        return v, np.stack([np.broadcast_to(c, np.shape(v)) for c in g], axis=-1)

    def column(self, x, params):
        return self.mean(x, [F.lit(float(p)) if isinstance(p, (int, float)) else p for p in params], COLUMNS)

    def self_start(self, x, y) -> list[float]:
        ux, uy = sorted_xy(x, y)
        with np.errstate(all="ignore"):
            out = [float(v) for v in self.start(ux, uy)]
        return [v if np.isfinite(v) else 1.0 for v in out]


_asymp_start = lambda ux, uy: [_top(ux, uy), uy[0], _rate(ux, uy, _top(ux, uy))]
CURVES = {
    c.name: c
    for c in (
        Curve("SSlogis", ("Asym", "xmid", "scal"), _logis, _start_logis),
        Curve("SSasymp", ("Asym", "R0", "lrc"), _asymp, _asymp_start),
        Curve("SSfol", ("Asym", "R0", "lrc"), _asymp, _asymp_start),
        Curve("SSmicmen", ("Vmax", "K"), _micmen, _start_micmen),
        Curve("SSgompertz", ("Asym", "b2", "b3"), _gompertz, _start_gompertz),
        Curve("SSpower", ("a", "b", "c"), _power, _start_power),
        Curve("SSfpl", ("A", "B", "xmid", "scal"), _fpl, _start_fpl),
        Curve("SSbiexp", ("A1", "lrc1", "A2", "lrc2"), _biexp, _start_biexp),
        Curve("SSweibull", ("Asym", "Drop", "lrc", "pwr"), _weibull, _start_weibull),
        Curve("SSasympOff", ("Asym", "lrc", "c0"), _asymp_off, lambda ux, uy: [_top(ux, uy), _rate(ux, uy, _top(ux, uy)), float(ux[0])]),
        Curve("SSasympOrig", ("Asym", "lrc"), _asymp_orig, lambda ux, uy: [_top(ux, uy), _rate(ux, uy, _top(ux, uy))]),
    )
}


def custom_curve(name: str, parameters, f) -> Curve:
    """A curve from ``f(x, params) -> (value, gradient)`` on plain numbers."""
    value, gradient = f(0.0, [1.0] * len(parameters))
    float(value)
    if len(gradient) != len(parameters):
        raise ValueError(f"the gradient has {len(gradient)} entries for {len(parameters)} parameters")

    def mean(x, p, m):
        shape = np.broadcast_shapes(np.shape(x), *[np.shape(v) for v in p])
        xs, ps = np.broadcast_to(x, shape).ravel(), [np.broadcast_to(v, shape).ravel() for v in p]
        rows = [f(float(x), [float(v[i]) for v in ps]) for i, x in enumerate(xs)]
        g = np.array([r[1] for r in rows], float).reshape(-1, len(parameters))
        return np.array([r[0] for r in rows], float).reshape(shape), tuple(g[:, j].reshape(shape) for j in range(len(parameters)))

    return Curve(name, tuple(parameters), mean, lambda ux, uy: [1.0] * len(parameters))
