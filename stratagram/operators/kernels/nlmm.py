"""Nonlinear mixed models: penalised nonlinear least squares and Laplace's criterion.

The kernel works on distinct (group, x) with count, mean response and the sum
of squares within: for normal errors an exact compression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from ...functions.curves import Curve
from ...functions.special import hermite_nodes
from .glmm import MOST_GRID, grid_order
from .optimize import nelder_mead, scalar


@dataclass
class Points:
    x: np.ndarray
    y: np.ndarray  # mean at (group, x)
    w: np.ndarray  # rows behind it
    within: float  # sum of squares around those means
    group: np.ndarray
    labels: list
    n: int


class Problem:
    def __init__(self, data: Points, curve: Curve, random: list[int], reml=False, lower=None, upper=None, group_lower=None, group_upper=None):
        self.d, self.curve, self.random, self.reml = data, curve, random, reml
        n, k = len(curve.parameters), len(random)
        self.m, self.k, self.p = len(data.labels), k, n
        self.lower = np.full(n, -np.inf) if lower is None else np.asarray(lower, float)
        self.upper = np.full(n, np.inf) if upper is None else np.asarray(upper, float)
        self.group_lower = np.full(n, -np.inf) if group_lower is None else np.asarray(group_lower, float)
        self.group_upper = np.full(n, np.inf) if group_upper is None else np.asarray(group_upper, float)

    def clip(self, beta, b):
        beta = np.clip(beta, self.lower, self.upper)
        r = self.random
        return beta, np.clip(b, self.group_lower[r] - beta[r], self.group_upper[r] - beta[r])

    def mean(self, beta, b):
        params = [np.full(len(self.d.x), v) for v in beta]
        for j, r in enumerate(self.random):
            params[r] = params[r] + b[self.d.group, j]
        return self.curve.values(self.d.x, params)

    def pnls(self, lam, beta, b, most=120, fixed=False):
        """Minimise RSS + |u|^2, b = lam u, by damped Gauss-Newton; groups are eliminated one by one.  ``fixed``: b alone."""
        d, k = self.d, self.k
        prior = np.linalg.inv(lam @ lam.T)
        penalty = lambda b: float(np.einsum("mi,ij,mj->", b, prior, b))
        beta, b = self.clip(beta, b)
        mu, grad = self.mean(beta, b)
        value = float((d.w * (d.y - mu) ** 2).sum()) + penalty(b)
        if not math.isfinite(value):
            return None
        damp = 1e-4
        for _ in range(most):
            r, z = d.y - mu, grad[:, self.random]
            add = lambda a: np.stack([np.bincount(d.group, a[:, j], self.m) for j in range(a.shape[1])], axis=1)
            s = add((z[:, :, None] * z[:, None, :] * d.w[:, None, None]).reshape(-1, k * k)).reshape(-1, k, k) + prior
            c = add((z[:, :, None] * grad[:, None, :] * d.w[:, None, None]).reshape(-1, k * self.p)).reshape(-1, k, self.p)
            g = add(z * (d.w * r)[:, None]) - b @ prior
            xx, xr = (grad * d.w[:, None]).T @ grad, grad.T @ (d.w * r)
            moved = 0.0
            for _ in range(14):
                try:
                    sd = s + damp * s * np.eye(k)
                    sc, sg = np.linalg.solve(sd, c), np.linalg.solve(sd, g[:, :, None])[:, :, 0]
                    a = xx + damp * np.diag(np.maximum(np.diag(xx), 1e-8)) - np.einsum("mkp,mkq->pq", c, sc)
                    db = np.zeros(self.p) if fixed else np.linalg.solve(a, xr - np.einsum("mkp,mk->p", c, sg))
                except np.linalg.LinAlgError:
                    damp = max(damp * 10, 1e-6)
                    continue
                du, step = sg - np.einsum("mkp,p->mk", sc, db), 1.0
                while step > 1e-5:
                    nb, nu = self.clip(beta + step * db, b + step * du)
                    m2, g2 = self.mean(nb, nu)
                    v = float((d.w * (d.y - m2) ** 2).sum()) + penalty(nu)
                    if v < value:
                        moved = value - v
                        beta, b, mu, grad, value = nb, nu, m2, g2, v
                        break
                    step /= 2
                if moved:
                    damp = max(damp * 0.3, 1e-10)
                    break
                damp = min(damp * 10, 1e8)
            if moved <= 1e-12 * (abs(value) + 1e-12):
                break
        return beta, b, value + d.within

    def criterion(self, lam, beta, b, pwrss, nodes=1):
        d, k = self.d, self.k
        mu, grad = self.mean(beta, b)
        z = grad[:, self.random] @ lam
        s = np.stack([np.bincount(d.group, v, self.m) for v in (z[:, :, None] * z[:, None, :] * d.w[:, None, None]).reshape(-1, k * k).T], axis=1).reshape(-1, k, k) + np.eye(k)
        sign, logdet = np.linalg.slogdet(s)
        df = d.n - self.p if self.reml else d.n
        sigma2 = pwrss / df
        value = df * (math.log(2 * math.pi * sigma2) + 1) + logdet.sum()
        if self.reml:
            c = np.stack([np.bincount(d.group, v, self.m) for v in (z[:, :, None] * grad[:, None, :] * d.w[:, None, None]).reshape(-1, k * self.p).T], axis=1).reshape(-1, k, self.p)
            v = (grad * d.w[:, None]).T @ grad - np.einsum("mkp,mkq->pq", c, np.linalg.solve(s, c))
            value += np.linalg.slogdet(v)[1]
        nodes = grid_order(nodes, k, MOST_GRID)
        if nodes > 1:
            x, w = hermite_nodes(nodes)
            half = np.linalg.inv(np.linalg.cholesky(s)).transpose(0, 2, 1)
            u0 = np.linalg.solve(lam, b.T).T
            grid = np.stack([v.ravel() for v in np.meshgrid(*[x] * k, indexing="ij")], axis=1)
            weight = np.prod(np.stack([v.ravel() for v in np.meshgrid(*[w] * k, indexing="ij")], axis=1), axis=1)
            base = np.bincount(d.group, d.w * (d.y - mu) ** 2, self.m) + (u0 * u0).sum(axis=1)
            logs = []
            for pt, wt in zip(grid, weight):
                u = u0 + math.sqrt(sigma2) * (half @ pt)
                m2, _ = self.mean(beta, u @ lam.T)
                logs.append(math.log(wt) + 0.5 * pt @ pt - 0.5 * (np.bincount(d.group, d.w * (d.y - m2) ** 2, self.m) + (u * u).sum(axis=1) - base) / sigma2)
            logs = np.array(logs)
            top = logs.max(axis=0)
            value += float(-2 * (top + np.log(np.exp(logs - top).sum(axis=0))).sum())
        return float(value), sigma2


def triangle(theta, k) -> np.ndarray:
    lam, at = np.zeros((k, k)), 0
    for j in range(k):
        lam[j:, j] = theta[at : at + k - j]
        at += k - j
    return lam


def fit(problem: Problem, starts: list, nodes: int = 1):
    """(theta, beta, b, sigma2, deviance, evaluations, converged): the best over the starts."""
    k, best = problem.k, None
    for start in starts:
        warm = [np.asarray(start, float), np.zeros((problem.m, k))]

        def solve(theta):
            lam = triangle(theta, k)
            if (np.abs(np.diag(lam)) < 1e-6).any():
                lam = lam + np.diag(np.where(np.abs(np.diag(lam)) < 1e-6, 1e-6, 0.0))
            out = problem.pnls(lam, warm[0], warm[1]) or problem.pnls(lam, np.asarray(start, float), np.zeros((problem.m, k)))
            if out is None:
                return None
            beta, b, pwrss = out
            value, sigma2 = problem.criterion(lam, beta, b, pwrss, nodes)
            if math.isfinite(value):
                warm[0], warm[1] = beta, b
            return value, beta, b, sigma2

        def f(theta):
            try:
                out = solve(theta)
            except np.linalg.LinAlgError:
                out = None
            return math.inf if out is None or not math.isfinite(out[0]) else out[0]

        if k == 1:
            t, v, n = scalar(lambda u: f(np.array([max(u, 1e-6)])), 1.0)
            theta, ok = np.array([max(t, 1e-6)]), True
        else:
            lower = np.array([1e-6 if i == j else -np.inf for j in range(k) for i in range(j, k)])
            theta, v, n, ok = nelder_mead(f, np.where(np.isfinite(lower), 1.0, 0.0), lower, step=0.5, tol=1e-9, most=1500)
        if math.isfinite(v) and (best is None or v < best[4] - 1e-9):
            out = solve(theta)
            if out is not None:
                best = (theta, out[1], out[2], out[3], out[0], n, ok)
    if best is None:
        raise ValueError("no start leads to a finite criterion; give start values")
    return best


def refine(problem: Problem, found, nodes: int = 1):
    """Theta and the fixed effects together at the least Laplace (or quadrature) deviance, from ``found``."""
    theta, beta, b, _, value, count, _ = found
    k, n = problem.k, len(theta)
    scale = 0.01 * np.abs(beta) + 1e-4
    warm = [b]

    def at(v):
        lam = triangle(v[:n], k)
        start = beta + v[n:] * scale
        out = problem.pnls(lam, start, warm[0], fixed=True) or problem.pnls(lam, start, np.zeros_like(b), fixed=True)
        if out is None:
            return None
        warm[0] = out[1]
        return out[0], out[1], *problem.criterion(lam, *out, nodes)

    def f(v):
        try:
            out = at(v)
        except np.linalg.LinAlgError:
            return math.inf
        return math.inf if out is None or not math.isfinite(out[2]) else out[2]

    lower = np.array([1e-6 if i == j else -np.inf for j in range(k) for i in range(j, k)] + [-np.inf] * len(beta))
    v, best, more, ok = nelder_mead(f, np.concatenate([theta, np.zeros(len(beta))]), lower, step=0.3, tol=1e-10)
    if best > value:
        return found
    new_beta, new_b, dev, sigma2 = at(v)
    return v[:n], new_beta, new_b, sigma2, dev, count + more, ok


def nls(curve: Curve, x, y, start=None, most: int = 200, weights=None, within: float = 0.0) -> dict:
    """Nonlinear least squares of one series; ``weights``: rows that each point stands for, ``within``: their squares about the points."""
    beta = np.asarray(start if start is not None else curve.self_start(x, y), float)
    x, y = np.asarray(x, float), np.asarray(y, float)
    w = np.ones(len(y)) if weights is None else np.asarray(weights, float)
    mu, g = curve.values(x, list(beta))
    rss, damp, ok = float((w * (y - mu) ** 2).sum()), 1e-3, False
    for _ in range(most):
        a, r = g.T @ (w[:, None] * g), g.T @ (w * (y - mu))
        gain = None
        for _ in range(14):
            try:
                step = np.linalg.solve(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), r)
            except np.linalg.LinAlgError:
                damp *= 10
                continue
            m2, g2 = curve.values(x, list(beta + step))
            new = float((w * (y - m2) ** 2).sum())
            if math.isfinite(new) and new <= rss:
                gain, beta, mu, g, rss, damp = rss - new, beta + step, m2, g2, new, max(damp / 5, 1e-14)
                break
            damp *= 10
        if gain is None or gain <= 1e-13 * (rss + 1e-300):
            ok = math.isfinite(rss)
            break
    return {"parameters": beta.tolist(), "rss": rss + within, "n": float(w.sum()), "converged": bool(ok)}
