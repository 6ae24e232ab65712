"""Profile likelihood intervals of linear mixed models, without another pass over the data.

A fixed coefficient held at c is the response y - c x_j on the other columns,
which is linear in the stored cross-products.  Standard deviations are held by
theta_i sigma = s, or sigma itself.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np

from ..functions import special
from ..plans.design import ModelError
from . import inference
from .gram import Factor, Gram
from .kernels import glmm, lmm
from .kernels.optimize import golden, lower_bounds, minimise_theta, nelder_mead
from .model import ConfidenceIntervals, FittedModel


def held(gram: Gram, j: int, value: float) -> Gram:
    """The sums of y - value x_j on the columns but j."""
    p = gram.p
    keep = [k for k in range(p) if k != j]
    m = np.zeros((p + 1, p))
    for c, k in enumerate(keep):
        m[k, c] = 1.0
    m[p, p - 1], m[j, p - 1] = 1.0, -value
    factors = [Factor(f.group, f.effects, f.blocks, f.labels, f.s, f.c @ m, f.n) for f in gram.factors]
    return Gram([gram.names[k] for k in keep], gram.n, m.T @ gram.t @ m, factors, gram.cross, gram.layout)


def _crossings(f, at: float, step: float, goal: float, low: float = -math.inf) -> tuple[float, float]:
    """Where f rises to ``goal`` on either side of ``at``."""
    out = []
    for sign in (-1, 1):
        inner, width = at, step
        while True:
            outer = max(low, at + sign * width)
            if f(outer) >= goal:
                break
            if outer == low or width > 1e6 * step:
                inner = None
                break
            inner, width = outer, width * 1.6
        if inner is None:
            out.append(low if sign < 0 else math.inf)
            continue
        a, b = inner, outer
        for _ in range(60):
            mid = (a + b) / 2
            a, b = (a, mid) if f(mid) >= goal else (mid, b)
            if abs(b - a) < 1e-9 * max(1.0, abs(a)):
                break
        out.append((a + b) / 2)
    return out[0], out[1]


def _fixed(model: FittedModel, gram: Gram, theta, least: float, j: int, goal: float, shift: float) -> tuple[float, float]:
    last = [theta]

    def f(value):
        g = held(gram, j, value)
        t, v, *_ = minimise_theta(lambda th: lmm.deviance(g, th, False), g.layout, last[0] if len(last[0]) > 1 else None)
        last[0] = t
        return v

    lo, hi = _crossings(f, float(model.coefficients[j] - shift), float(model.beta_se[j]), least + goal)
    return lo + shift, hi + shift


def _held_sd(gram: Gram, index: int | None, s: float, theta, sigma: float) -> float:
    """Least unprofiled deviance with sigma = s (index None) or theta[index] sigma = s."""
    n, p = gram.n, gram.p
    bounds = lower_bounds(gram.layout)
    free = [k for k in range(len(theta)) if k != index]

    def dev(th, log_sigma):
        try:
            sol = lmm.Solution(gram, th)
            rss = sol.s[p, p] - (sol.s[:p, p] @ np.linalg.solve(sol.s[:p, :p], sol.s[:p, p]) if p else 0.0)
        except np.linalg.LinAlgError:
            return math.inf
        return n * (math.log(2 * math.pi) + 2 * log_sigma) + sol.logdet + rss / math.exp(2 * log_sigma)

    if index is None:
        ls = math.log(s)
        if len(theta) == 1:
            return min(golden(lambda u: dev(np.array([math.exp(u)]), ls), math.log(max(theta[0], 1e-3)) - 6, math.log(max(theta[0], 1e-3)) + 6)[1], dev(np.zeros(1), ls))
        return nelder_mead(lambda t: dev(t, ls), theta, bounds, step=0.1)[1]

    def f(v):
        th = np.array(theta, float)
        th[free] = v[1:]
        th[index] = s / math.exp(v[0])
        return dev(th, v[0])

    if not free:
        return golden(lambda u: f(np.array([u])), math.log(sigma) - 3, math.log(sigma) + 3)[1]
    return nelder_mead(f, np.concatenate([[math.log(sigma)], np.array(theta)[free]]), np.concatenate([[-math.inf], bounds[free]]), step=0.1)[1]


def profile_intervals(model: FittedModel, level: float = 0.95, parms=None, which: str = "fixed") -> ConfidenceIntervals:
    """which: fixed, variance (.sig01, ..., .sigma) or all."""
    if which not in ("fixed", "variance", "all"):
        raise ModelError(f"unknown scope {which!r}: fixed, variance or all")
    goal = special.chi2_ppf(level, 1)
    if model.kind == "glmer":
        return _glmm(model, level, parms, which, goal)
    if model.kind != "lmer" or model.gram is None:
        raise ModelError("profiles are for mixed models fitted in this session")
    ml, _, _ = lmm.fit(model.gram, reml=False, start=model.theta if len(model.theta) > 1 else None)
    names, lower, upper = [], [], []
    if which in ("variance", "all"):
        sigma = math.sqrt(ml.sigma2)
        for k in [*range(len(ml.theta)), None]:
            est = sigma if k is None else float(ml.theta[k]) * sigma
            diagonal = k is None or lower_bounds(model.gram.layout)[k] == 0
            f = lambda s, k=k: _held_sd(model.gram, k, s, ml.theta, sigma)
            lo, hi = _crossings(f, est, max(abs(est) * 0.2, sigma * 0.02), ml.deviance + goal, (1e-9 if k is None else 0.0) if diagonal else -math.inf)
            names.append(".sigma" if k is None else f".sig{k + 1:02d}")
            lower.append(lo)
            upper.append(hi)
    if which in ("fixed", "all"):
        for j in inference._parms(model, parms):
            shift = model.design.shift if model.fixed_names[j] == "(Intercept)" else 0.0
            lo, hi = _fixed(model, model.gram, ml.theta, ml.deviance, j, goal, shift)
            names.append(model.fixed_names[j])
            lower.append(lo)
            upper.append(hi)
    return ConfidenceIntervals(names, lower, upper, level, "profile")


def _glmm(model: FittedModel, level, parms, which, goal) -> ConfidenceIntervals:
    d, nodes = model.extra["patterns"], model.extra["n_agq"]
    names, lower, upper = [], [], []
    if which in ("variance", "all") and len(model.theta) == 1:
        f = lambda s: (lambda st: math.inf if st is None else st.deviance)(glmm.profile(d, model.family, model.link, np.array([s]), nodes))
        lo, hi = _crossings(f, float(model.theta[0]), max(0.1, 0.2 * float(model.theta[0])), model.deviance + goal, 0.0)
        names, lower, upper = [".sig01"], [lo], [hi]
    if which in ("fixed", "all"):
        for j in inference._parms(model, parms):
            keep = [k for k in range(d.x.shape[1]) if k != j]

            def f(value, j=j, keep=keep):
                fixed = replace(d, x=d.x[:, keep], offset=d.offset + value * d.x[:, j], names=[d.names[k] for k in keep])
                return minimise_theta(lambda t: (lambda st: math.inf if st is None else st.deviance)(glmm.profile(fixed, model.family, model.link, t, nodes)), d.layout, model.theta if len(model.theta) > 1 else None)[1]

            lo, hi = _crossings(f, float(model.coefficients[j]), float(model.beta_se[j]), f(float(model.coefficients[j])) + goal)
            names.append(model.fixed_names[j])
            lower.append(lo)
            upper.append(hi)
    return ConfidenceIntervals(names, lower, upper, level, "profile")
