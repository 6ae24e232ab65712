"""Derivative-free minimisation with lower bounds."""

from __future__ import annotations

import math

import numpy as np

_GOLD = (math.sqrt(5) - 1) / 2


def golden(f, lo: float, hi: float, tol: float = 1e-10, most: int = 200) -> tuple[float, float]:
    a, b = lo, hi
    c, d = b - _GOLD * (b - a), a + _GOLD * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(most):
        if abs(b - a) <= tol * max(1.0, abs(a) + abs(b)):
            break
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - _GOLD * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + _GOLD * (b - a)
            fd = f(d)
    x = (a + b) / 2
    return x, f(x)


def scalar(f, start: float = 1.0) -> tuple[float, float, int]:
    """Least f over [0, inf): a log grid that widens while its ends are best, golden section, and 0 itself."""
    seen: dict[float, float] = {}

    def g(u):
        if u not in seen:
            seen[u] = f(math.exp(u))
        return seen[u]

    at = math.log(max(start, 1e-6))
    lo, hi = at - 4.0, at + 4.0
    for _ in range(12):
        grid = np.linspace(lo, hi, 13).tolist()
        k = int(np.argmin([g(u) for u in grid]))
        if 0 < k < 12 or lo < -12 and k == 0 or hi > 16 and k == 12:
            break
        lo, hi = (lo - 6.0, hi) if k == 0 else (lo, hi + 6.0)
    step = (hi - lo) / 12
    u, best = golden(g, grid[k] - step, grid[k] + step, 1e-9)
    zero = f(0.0)
    return (0.0, zero, len(seen) + 1) if zero <= best + 1e-10 else (math.exp(u), best, len(seen) + 1)


def nelder_mead(f, start, lower, step: float = 0.25, tol: float = 1e-11, most: int = 4000, restarts: int = 6):
    """(x, value, evaluations, converged); starts anew from its result until that gains nothing."""
    lower, x = np.asarray(lower, float), np.maximum(np.asarray(start, float), lower)
    count, best = 0, math.inf

    def g(v):
        nonlocal count
        count += 1
        y = f(np.maximum(v, lower))
        return y if math.isfinite(y) else 1e300

    for round_ in range(restarts):
        n = len(x)
        simplex = [x] + [x + step / (1 + 2 * round_) * (1 if k % 2 == round_ % 2 or x[k] - step < lower[k] else -1) * np.eye(n)[k] * max(1.0, abs(x[k])) for k in range(n)]
        values = [g(v) for v in simplex]
        while count < most:
            order = np.argsort(values, kind="stable")
            simplex, values = [simplex[i] for i in order], [values[i] for i in order]
            if abs(values[-1] - values[0]) <= tol * (abs(values[0]) + 1e-3) and max(np.abs(s - simplex[0]).max() for s in simplex) < 1e-6 * max(1.0, np.abs(simplex[0]).max()):
                break
            centre = np.mean(simplex[:-1], axis=0)
            r = centre + (centre - simplex[-1])
            fr = g(r)
            if fr < values[0]:
                e = centre + 2 * (centre - simplex[-1])
                fe = g(e)
                simplex[-1], values[-1] = (e, fe) if fe < fr else (r, fr)
            elif fr < values[-2]:
                simplex[-1], values[-1] = r, fr
            else:
                c = centre + 0.5 * ((r if fr < values[-1] else simplex[-1]) - centre)
                fc = g(c)
                if fc < min(fr, values[-1]):
                    simplex[-1], values[-1] = c, fc
                else:
                    simplex = [simplex[0]] + [simplex[0] + 0.5 * (s - simplex[0]) for s in simplex[1:]]
                    values = [values[0]] + [g(s) for s in simplex[1:]]
        k = int(np.argmin(values))
        gain, best, x = best - values[k], values[k], np.maximum(simplex[k], lower)
        if round_ and gain < 1e-9 * (abs(best) + 1):
            return x, best, count, True
    return x, best, count, count < most


def lower_bounds(layout) -> np.ndarray:
    """0 for the diagonal of each block's triangle, none off it."""
    out = []
    for _, _, k, _ in layout:
        out += [0.0 if i == j else -math.inf for j in range(k) for i in range(j, k)]
    return np.array(out)


def start_theta(layout) -> np.ndarray:
    return np.array([1.0 if b == 0.0 else 0.0 for b in lower_bounds(layout)])


def minimise_theta(f, layout, start=None):
    """(theta, value, evaluations, converged) of a profile over theta."""
    bounds = lower_bounds(layout)
    start = start_theta(layout) if start is None else np.asarray(start, float)
    if len(bounds) == 1:
        t, v, n = scalar(lambda u: f(np.array([u])), float(start[0]) or 1.0)
        return np.array([t]), v, n, True
    x, v, n, ok = nelder_mead(f, start, bounds)
    # The boundary itself, one variance at a time.
    for k in np.flatnonzero(bounds == 0):
        if 0 < x[k] < 1e-2:
            z = x.copy()
            z[k] = 0.0
            if (fz := f(z)) <= v + 1e-9:
                x, v = z, fz
    return x, v, n, ok
