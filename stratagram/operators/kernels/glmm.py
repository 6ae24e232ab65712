"""Penalised iteratively reweighted least squares on compressed rows.

Rows that agree in response, design, groups and offset contribute alike, so
the kernel works on distinct patterns with summed weights: an exact
compression, done in Spark before anything reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np

from ...functions.families import NUMPY, Family, Link
from ...functions.special import hermite_nodes
from ..gram import Factor, Gram
from .lmm import Solution
from .optimize import lower_bounds, minimise_theta, nelder_mead, scalar

NODES_ALLOWED = (1, 3, 5, 7, 9, 11)
MOST_GRID, MOST_JOINT, JOINT_EFFECTS = 400, 7000, 8


def grid_order(nodes: int, dimensions: int, most: int) -> int:
    """The largest order up to ``nodes`` whose grid has at most ``most`` points; 1 (Laplace) if none has."""
    lower = [n for n in reversed(NODES_ALLOWED) if n < nodes]
    return next((n for n in (nodes, *lower) if n**dimensions <= most), 1)


def order_used(d: Patterns, q: int, nodes: int) -> tuple[bool, int]:
    """(by group, order) of the quadrature with ``q`` random effects in all: by group for one grouping, else jointly."""
    by_group = grid_order(nodes, sum(len(f.effects) for f in d.factors), MOST_GRID) if len(d.factors) == 1 else 1
    if by_group > 1:
        return True, by_group
    return False, grid_order(nodes, q, MOST_JOINT) if q <= JOINT_EFFECTS else 1


@dataclass
class Patterns:
    x: np.ndarray  # (r, p)
    y: np.ndarray
    w: np.ndarray  # prior weights, summed over equal rows
    offset: np.ndarray
    groups: list  # row -> group number, by factor
    z: list  # (r, k) by factor
    factors: list
    layout: list
    names: list
    n: int
    within: float = 0.0  # deviance of the rows about their pattern's response

    def gram(self, w, z_response) -> Gram:
        xy = np.concatenate([self.x, z_response[:, None]], axis=1)
        t = (xy * w[:, None]).T @ xy
        factors = []
        for f, g, z in zip(self.factors, self.groups, self.z):
            m = len(f.labels)
            add = lambda a: np.stack([np.bincount(g, a[:, j], m) for j in range(a.shape[1])], axis=1)
            k = z.shape[1]
            s = add((z[:, :, None] * z[:, None, :] * w[:, None, None]).reshape(len(w), k * k)).reshape(m, k, k)
            c = add((z[:, :, None] * xy[:, None, :] * w[:, None, None]).reshape(len(w), -1)).reshape(m, k, -1)
            factors.append(Factor(f.group, f.effects, f.blocks, f.labels, s, c, f.n))
        cross = {}
        for a in range(len(factors)):
            for b in range(a + 1, len(factors)):
                mb = len(factors[b].labels)
                code, where = np.unique(self.groups[a] * mb + self.groups[b], return_inverse=True)
                v = (self.z[a][:, :, None] * self.z[b][:, None, :] * w[:, None, None]).reshape(len(w), -1)
                v = np.stack([np.bincount(where, v[:, j], len(code)) for j in range(v.shape[1])], axis=1)
                cross[(a, b)] = (code // mb, code % mb, v.reshape(len(code), self.z[a].shape[1], self.z[b].shape[1]))
        return Gram(self.names, self.n, t, factors, cross, self.layout)

    def zb(self, b) -> np.ndarray:
        out = np.zeros(len(self.y))
        for g, z, v in zip(self.groups, self.z, b):
            out += (z * v[g]).sum(axis=1)
        return out


class State:
    """Where the iterations ended, for one theta."""


def pirls(d: Patterns, fam: Family, lk: Link, theta, phi: float = 1.0, start: State | None = None) -> State | None:
    positive = lk.name == "inverse"
    if start is None:
        mu = fam.start(d.y, NUMPY)
        eta = lk.link(mu, NUMPY)
    else:
        eta = start.eta
        mu = lk.inverse(eta, NUMPY)
    old = math.inf
    for _ in range(1000 if positive else 100):
        me = lk.mu_eta(eta, NUMPY)
        w = np.maximum(d.w * me * me / (phi * fam.variance(mu, NUMPY)), 1e-300)
        z = eta - d.offset + (d.y - mu) / np.where(np.abs(me) < 2.2e-16, 2.2e-16, me)
        gram = d.gram(w, z)
        try:
            sol = Solution(gram, theta)
            p = gram.p
            beta = np.linalg.solve(sol.s[:p, :p], sol.s[:p, p])
        except np.linalg.LinAlgError:
            return None
        u = sol.effects(np.concatenate([-beta, [1.0]]))
        b = [v @ lam.T for v, lam in zip(u, sol.lam)]
        target, step = d.x @ beta + d.zb(b) + d.offset, 1.0
        for _ in range(100 if positive else 25):
            new = eta + step * (target - eta)
            if np.isfinite(new).all() and (not positive or (new > 2.2e-16).all()) and np.isfinite(lk.inverse(new, NUMPY)).all():
                break
            step /= 2
        else:
            return None
        penalty = sum(float((v * v).sum()) for v in u)
        pwrss = penalty + float((w * (z + d.offset - new) ** 2).sum())
        eta, mu = new, lk.inverse(new, NUMPY)
        if abs(old - pwrss) / (pwrss + 0.1) < 1e-10:
            out = State()
            out.beta, out.u, out.b, out.eta, out.mu, out.w = beta, u, b, eta, mu, w
            out.dev = float(fam.deviance(d.y, mu, d.w, NUMPY).sum()) + d.within
            out.penalty, out.logdet, out.phi, out.sol, out.gram, out.theta = penalty, sol.logdet, phi, sol, gram, theta
            fit_term = fam.aic(d.y, mu, d.w, out.dev, d.within) - 2 if fam.dispersion else out.dev
            out.deviance = fit_term + sol.logdet + penalty
            return out
        old = pwrss
    return None


def profile(d: Patterns, fam: Family, lk: Link, theta, nodes: int = 1, start: State | None = None) -> State | None:
    """PIRLS with the dispersion profiled where the family has one; AGQ replaces the Laplace term."""
    if not fam.dispersion:
        s = pirls(d, fam, lk, theta, 1.0, start)
    else:
        total, phi, s = max(1.0, float(d.w.sum())), 1.0 if start is None else start.phi, start
        for _ in range(200):
            s = pirls(d, fam, lk, theta, phi, s) or pirls(d, fam, lk, theta, phi)
            if s is None or s.dev <= 0:
                break
            new = max(s.dev / total, 2.2e-16)
            if abs(new - phi) / phi < 1e-8:
                break
            phi = new
    if s is not None and nodes > 1:
        s.deviance = quadrature(d, fam, lk, s, nodes)
    return s


def quadrature(d: Patterns, fam: Family, lk: Link, s: State, nodes: int) -> float:
    """Adaptive Gauss-Hermite in place of Laplace: one grouping by group, several jointly if small, in the highest order that fits."""
    k = sum(len(f.effects) for f in d.factors)
    q = sum(v.size for v in s.u)
    by_group, nodes = order_used(d, q, nodes)
    if nodes == 1:
        return s.deviance
    x, w = hermite_nodes(nodes)
    base = d.x @ s.beta + d.offset
    dev = lambda eta: fam.deviance(d.y, lk.inverse(eta, NUMPY), d.w, NUMPY) / s.phi
    fit0 = (fam.aic(d.y, s.mu, d.w, s.dev, d.within) - 2 if fam.dispersion else s.dev) - (s.dev - d.within) / s.phi
    if by_group:
        f, g, lam = d.factors[0], d.groups[0], s.sol.lam[0]
        m = len(f.labels)
        half = np.linalg.inv(s.sol.l0).transpose(0, 2, 1)  # A^(-1/2) by group
        grid = np.stack([v.ravel() for v in np.meshgrid(*[x] * k, indexing="ij")], axis=1)
        weight = np.prod(np.stack([v.ravel() for v in np.meshgrid(*[w] * k, indexing="ij")], axis=1), axis=1)
        logs = []
        for point, wt in zip(grid, weight):
            u = s.u[0] + half @ point
            eta = base + (d.z[0] * (u @ lam.T)[g]).sum(axis=1)
            total = np.bincount(g, dev(eta), m) + (u * u).sum(axis=1)
            logs.append(math.log(wt) + 0.5 * (point @ point) - 0.5 * total)
        logs = np.array(logs)
        top = logs.max(axis=0)
        lse = top + np.log(np.exp(logs - top).sum(axis=0))
        return float(-2 * lse.sum() + s.logdet + fit0)
    a = np.eye(q)
    at = np.concatenate([[0], np.cumsum([v.size for v in s.u])])
    design = np.zeros((len(d.y), q))
    for i, (g, z) in enumerate(zip(d.groups, d.z)):
        zl = z @ s.sol.lam[i]
        for j in range(zl.shape[1]):
            design[np.arange(len(g)), at[i] + g * zl.shape[1] + j] += zl[:, j]
    a += (design * s.w[:, None]).T @ design
    half, u0 = np.linalg.inv(np.linalg.cholesky(a)).T, np.concatenate([v.ravel() for v in s.u])
    grid = np.stack([v.ravel() for v in np.meshgrid(*[x] * q, indexing="ij")], axis=1)
    weight = np.prod(np.stack([v.ravel() for v in np.meshgrid(*[w] * q, indexing="ij")], axis=1), axis=1)
    logs = np.array([math.log(wt) + 0.5 * (pt @ pt) - 0.5 * (dev(base + design @ (u0 + half @ pt)).sum() + ((u0 + half @ pt) ** 2).sum()) for pt, wt in zip(grid, weight)])
    top = logs.max()
    return float(-2 * (top + math.log(np.exp(logs - top).sum())) + s.logdet + fit0)


def refine(d: Patterns, fam: Family, lk: Link, theta, s: State, nodes: int = 1):
    """Theta and the fixed effects together at the least Laplace (or quadrature) deviance, from a PIRLS fit."""
    p, k = d.x.shape[1], len(theta)
    se = np.sqrt(np.diag(np.linalg.inv(s.sol.s[:p, :p])))

    def at(v):
        beta = s.beta + v[k:] * se
        held = replace(d, x=d.x[:, :0], offset=d.offset + d.x @ beta, names=[])
        return beta, profile(held, fam, lk, v[:k], nodes)

    def f(v):
        out = at(v)[1]
        return math.inf if out is None else out.deviance

    v, _, count, ok = nelder_mead(f, np.concatenate([theta, np.zeros(p)]), np.concatenate([lower_bounds(d.layout), np.full(p, -math.inf)]), step=0.1)
    beta, out = at(v)
    out.beta, out.gram = beta, d.gram(out.w, out.eta - d.offset)
    out.sol = Solution(out.gram, v[:k])
    return out, v[:k], count, ok


def fit(d: Patterns, fam: Family, lk: Link, nodes: int = 1):
    """(state, theta, evaluations, converged).  Laplace first; quadrature starts from it."""
    if nodes not in NODES_ALLOWED:
        raise ValueError(f"n_agq is one of {NODES_ALLOWED}")
    if not d.layout:
        s = profile(d, fam, lk, [])
        if s is None:
            raise ValueError("the iterations did not converge")
        return s, np.zeros(0), 0, True
    last: list = [None]

    def objective(theta, n=1):
        s = profile(d, fam, lk, theta, n, last[0]) or profile(d, fam, lk, theta, n)
        if s is None:
            return math.inf
        last[0] = s
        return s.deviance

    theta, value, count, ok = minimise_theta(objective, d.layout)
    if nodes > 1:
        f = lambda t: objective(t, nodes)
        if len(theta) == 1:
            t, v, n = scalar(lambda u: f(np.array([u])), max(float(theta[0]), 1e-2))
            again = np.array([t])
        else:
            again, v, n, ok = nelder_mead(f, theta, lower_bounds(d.layout), step=0.05)
        if math.isfinite(v):
            theta, count = again, count + n
    s = profile(d, fam, lk, theta, nodes)
    if s is None:
        raise ValueError("the iterations did not converge at the estimate")
    return s, np.asarray(theta), count, ok

