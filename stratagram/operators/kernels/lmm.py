"""Penalised least squares on cross-products.

With A = L'Z'WZL + I the profile is what is left of [X y]'W[X y] after the
random effects are eliminated: the largest factor group by group (its part of
A is block diagonal), the others as one dense block.
"""

from __future__ import annotations

import math

import numpy as np

from .optimize import minimise_theta

#: Random effects of all factors but the largest.
MOST_DENSE = 6000
_DENSE_CROSS = 30_000_000


class Singular(ValueError):
    pass


def lambdas(theta, gram) -> list[np.ndarray]:
    """Lower triangles by factor; theta holds each term's triangle by columns."""
    out = [np.zeros((len(f.effects), len(f.effects))) for f in gram.factors]
    at = 0
    for factor, first, k, _ in gram.layout:
        for j in range(k):
            out[factor][first + j : first + k, first + j] = theta[at : at + k - j]
            at += k - j
    return out


def _triangles(a: np.ndarray) -> np.ndarray:
    """Cholesky triangles of many small matrices, entry by entry over all of them."""
    k = a.shape[1]
    out = np.zeros_like(a)
    for j in range(k):
        d = a[:, j, j] - (out[:, j, :j] ** 2).sum(axis=1)
        if not (d > 0).all():
            raise np.linalg.LinAlgError("not positive definite")
        out[:, j, j] = np.sqrt(d)
        for i in range(j + 1, k):
            out[:, i, j] = (a[:, i, j] - (out[:, i, :j] * out[:, j, :j]).sum(axis=1)) / out[:, j, j]
    return out


def _forward(l: np.ndarray, c: np.ndarray) -> np.ndarray:  # noqa: E741
    """Solutions of many small lower triangles."""
    out = np.empty_like(c)
    for j in range(l.shape[1]):
        v = c[:, j]
        for i in range(j):
            v = v - l[:, j, i, None] * out[:, i]
        out[:, j] = v / l[:, j, j, None]
    return out


class Solution:
    """The profile at one theta; ``x_tail`` columns of the sums are responses."""

    def __init__(self, gram, theta):
        self.gram, self.lam = gram, lambdas(theta, gram)
        f0 = max(range(len(gram.factors)), key=lambda i: gram.factors[i].s.shape[0], default=None)
        self.first, self.rest = f0, [i for i in range(len(gram.factors)) if i != f0]
        s, self.logdet = gram.t.copy(), 0.0
        if f0 is not None:
            f, lam = gram.factors[f0], self.lam[f0]
            k = len(f.effects)
            a = (f.s.reshape(-1, k * k) @ np.kron(lam, lam)).reshape(-1, k, k) + np.eye(k)
            self.l0 = _triangles(a)
            self.r0 = _forward(self.l0, np.tensordot(f.c, lam, axes=([1], [0])).transpose(0, 2, 1))
            self.logdet += 2 * np.log(np.diagonal(self.l0, axis1=1, axis2=2)).sum()
            s -= np.tensordot(self.r0, self.r0, axes=([0, 1], [0, 1]))
        if self.rest:
            s -= self._rest()
        self.s = s

    def _rest(self):
        g = self.gram
        sizes = [g.factors[i].s.shape[0] * len(g.factors[i].effects) for i in self.rest]
        at = np.concatenate([[0], np.cumsum(sizes)])
        q = int(at[-1])
        if q > MOST_DENSE:
            raise Singular(f"{q} random effects beside the largest grouping; at most {MOST_DENSE} can be held")
        d, c, entries = np.eye(q), np.zeros((q, g.t.shape[0])), []
        for n, i in enumerate(self.rest):
            f, lam = g.factors[i], self.lam[i]
            m, k = f.s.shape[0], len(f.effects)
            c[at[n] : at[n + 1]] = (lam.T @ f.c).reshape(m * k, -1)
            block = lam.T @ f.s @ lam
            rows = at[n] + np.arange(m)[:, None] * k + np.arange(k)
            d[rows[:, :, None], rows[:, None, :]] += block
            for n2 in range(n):
                j = self.rest[n2]
                (u, v, z), flip = (g.cross[(j, i)], False) if (j, i) in g.cross else (g.cross[(i, j)], True)
                if flip:
                    u, v, z = v, u, z.transpose(0, 2, 1)
                w = self.lam[j].T @ z @ lam
                kj = len(g.factors[j].effects)
                r, cc = at[n2] + u[:, None] * kj + np.arange(kj), at[n] + v[:, None] * k + np.arange(k)
                np.add.at(d, (r[:, :, None], cc[:, None, :]), w)
                np.add.at(d, (cc[:, :, None], r[:, None, :]), w.transpose(0, 2, 1))
            key = (self.first, i)
            u, v, z = g.cross[key] if key in g.cross else (lambda x: (x[1], x[0], x[2].transpose(0, 2, 1)))(g.cross[(i, self.first)])
            w = np.linalg.solve(self.l0[u], self.lam[self.first].T @ z @ lam)
            entries.append((u, at[n] + v[:, None] * k + np.arange(k), w))
        self.entries = entries
        m0, k0 = self.l0.shape[:2]
        if m0 * k0 * q <= _DENSE_CROSS:
            b = np.zeros((m0, k0, q))
            for u, cols, w in entries:
                b[u[:, None, None], np.arange(k0)[None, :, None], cols[:, None, :]] += w
            b = b.reshape(m0 * k0, q)
            d -= b.T @ b
            c -= b.T @ self.r0.reshape(m0 * k0, -1)
            self.b = b
        else:
            self.b = None
            self._sparse(d, c, entries)
        self.ld = np.linalg.cholesky(d)
        self.r1 = np.linalg.solve(self.ld, c)
        self.logdet += 2 * np.log(np.diag(self.ld)).sum()
        return self.r1.T @ self.r1

    def _sparse(self, d, c, entries):
        """Each group's few partners, pair by pair."""
        u = np.concatenate([np.repeat(e[0], e[1].shape[1]) for e in entries])
        col = np.concatenate([e[1].ravel() for e in entries])
        w = np.concatenate([e[2].transpose(0, 2, 1).reshape(-1, e[2].shape[1]) for e in entries])
        order = np.argsort(u, kind="stable")
        u, col, w = u[order], col[order], w[order]
        np.subtract.at(c, col, np.einsum("ek,ekr->er", w, self.r0[u]))
        most = int(np.bincount(u).max())
        if most > 512:
            raise Singular("two groupings that cross too densely to be eliminated")
        for gap in range(most):
            n = len(u) - gap
            same = u[:n] == u[gap:]
            v = np.einsum("ek,ek->e", w[:n][same], w[gap:][same])
            np.subtract.at(d, (col[:n][same], col[gap:][same]), v)
            if gap:
                np.subtract.at(d, (col[gap:][same], col[:n][same]), v)

    def effects(self, rhs: np.ndarray) -> list[np.ndarray]:
        """u by factor (m, k) for the combination ``rhs`` of [X y] (y - X beta: (-beta, 1))."""
        g, out = self.gram, [None] * len(self.gram.factors)
        if self.first is None:
            return out
        r = self.r0 @ rhs
        if self.rest:
            v = np.linalg.solve(self.ld.T, self.r1 @ rhs)
            at = 0
            for i in self.rest:
                m, k = g.factors[i].s.shape[0], len(g.factors[i].effects)
                out[i] = v[at : at + m * k].reshape(m, k)
                at += m * k
            for u, cols, w in self.entries:
                np.subtract.at(r, u, np.einsum("ekc,ec->ek", w, v[cols]))
        out[self.first] = np.linalg.solve(self.l0.transpose(0, 2, 1), r[:, :, None])[:, :, 0]
        return out


def deviance(gram, theta, reml: bool) -> float:
    try:
        s = Solution(gram, theta)
        return profile_deviance(s.s, s.logdet, gram.n, reml)
    except np.linalg.LinAlgError:
        return math.inf


def profile_deviance(s, logdet, n, reml) -> float:
    p = s.shape[0] - 1
    df = n - p if reml else n
    if p:
        lx = np.linalg.cholesky(s[:p, :p])
        r = np.linalg.solve(lx, s[:p, p])
        rss = s[p, p] - r @ r
        extra = 2 * np.log(np.diag(lx)).sum() if reml else 0.0
    else:
        rss, extra = s[p, p], 0.0
    if rss <= 0 or df <= 0:
        return math.inf
    return float(df * (math.log(2 * math.pi * rss / df) + 1) + logdet + extra)


class LmmFit:
    """Estimates at theta-hat."""

    @classmethod
    def of(cls, **values) -> "LmmFit":
        """From values that were found elsewhere."""
        out = cls.__new__(cls)
        out.__dict__.update(values)
        return out

    def __init__(self, gram, theta, reml: bool):
        self.gram, self.theta, self.reml = gram, np.asarray(theta, float), reml
        sol = Solution(gram, theta)
        p = gram.p
        try:
            lx = np.linalg.cholesky(sol.s[:p, :p])
        except np.linalg.LinAlgError:
            raise Singular("the fixed effects are linearly dependent") from None
        self.l_x = lx
        self.v_unscaled = np.linalg.inv(sol.s[:p, :p])
        self.beta = np.linalg.solve(sol.s[:p, :p], sol.s[:p, p])
        r = np.linalg.solve(lx, sol.s[:p, p])
        self.rss = float(sol.s[p, p] - r @ r)
        self.df = gram.n - p if reml else gram.n
        self.sigma2 = self.rss / self.df
        self.deviance = profile_deviance(sol.s, sol.logdet, gram.n, reml)
        self.logdet = sol.logdet
        self.u = sol.effects(np.concatenate([-self.beta, [1.0]]))
        self.b = [u @ lam.T for u, lam in zip(self.u, sol.lam)]
        self.covariance = [lam @ lam.T * self.sigma2 for lam in sol.lam]


def check_rank(gram) -> None:
    p = gram.p
    scale = np.sqrt(np.maximum(np.diag(gram.t)[:p], 1e-300))
    if p and np.linalg.eigvalsh(gram.t[:p, :p] / np.outer(scale, scale))[0] < 1e-13:
        raise Singular("the fixed effects are linearly dependent")


def fit(gram, reml: bool = True, start=None) -> tuple[LmmFit, int, bool]:
    if gram.n <= gram.p:
        raise Singular(f"{gram.n} rows for {gram.p} coefficients")
    check_rank(gram)
    if not gram.layout:
        return LmmFit(gram, [], reml), 0, True
    theta, _, n, ok = minimise_theta(lambda t: deviance(gram, t, reml), gram.layout, start)
    return LmmFit(gram, theta, reml), n, ok
