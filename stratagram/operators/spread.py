"""Nonlinear mixed models whose points stay in Spark.

For a theta and fixed effects a group's own effects are found in its task, so a
pass brings back sums of fixed size: the penalised squares, the determinants,
and the fixed effects' equations with all groups eliminated.  The driver holds
no points; of the groups it gets the effects, once, at the end.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.curves import Curve
from ..plans.design import ModelError
from .distributed import parabola
from .gram import MOST_GROUPS
from .kernels import nlmm
from .kernels.optimize import nelder_mead

#: Points of whole groups that a task works on at once.
AT_ONCE = 100_000


def whole_groups(batches, size: int = AT_ONCE):
    """Tables of about ``size`` rows or more that hold whole groups, of rows sorted by g."""
    held, n, goal = [], 0, size
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= goal:
            t = pa.Table.from_batches(held).combine_chunks()
            cut = pc.index(t["g"], t["g"][-1]).as_py()
            if cut:
                yield t.slice(0, cut)
                held, n = t.slice(cut).to_batches(), t.num_rows - cut
            goal = max(size, 2 * n)
    if n:
        yield pa.Table.from_batches(held)


def own_effects(problem: nlmm.Problem, lam, beta, most: int = 50):
    """(beta, b, penalised squares) of the groups' own effects by full Gauss-Newton steps; by damped ones where a step fails."""
    d, k, random = problem.d, problem.k, problem.random
    prior = np.linalg.inv(lam @ lam.T)
    value_at = lambda mu, b: float((d.w * (d.y - mu) ** 2).sum()) + float(np.einsum("mi,ij,mj->", b, prior, b))
    beta, b = problem.clip(beta, np.zeros((problem.m, k)))
    mu, grad = problem.mean(beta, b)
    value = value_at(mu, b)
    for _ in range(most if math.isfinite(value) else 0):
        wz = grad[:, random] * d.w[:, None]
        s, r = np.empty((problem.m, k, k)), d.y - mu
        for i in range(k):
            for j in range(i, k):
                s[:, i, j] = s[:, j, i] = np.bincount(d.group, wz[:, i] * grad[:, random[j]], problem.m)
        g = np.stack([np.bincount(d.group, wz[:, i] * r, problem.m) for i in range(k)], axis=1) - b @ prior
        _, new = problem.clip(beta, b + np.linalg.solve(s + prior, g[:, :, None])[:, :, 0])
        mu2, grad2 = problem.mean(beta, new)
        got = value_at(mu2, new)
        if not got <= value * (1 + 1e-13):
            break
        gain, b, mu, grad, value = value - got, new, mu2, grad2, got
        if gain <= 1e-12 * (abs(value) + 1e-12):
            return beta, b, value
    return problem.pnls(lam, beta, b, fixed=True)


class Spread:
    """What ``nlmm.Problem`` is for points on the driver; ``rows`` (g, x, m, n) hold each group in one partition, sorted by g."""

    def __init__(self, rows: DataFrame, curve: Curve, random: list[int], n: int, within: float, reml, lower, upper, group_lower, group_upper):
        self.rows, self.curve, self.random, self.n, self.within, self.reml = rows, curve, random, n, within, reml
        self.k, self.p = len(random), len(curve.parameters)
        self.lower, self.upper, self.group_lower, self.group_upper = lower, upper, group_lower, group_upper

    def _parts(self, lam, beta):
        """A function of a task's batches: each part's problem with its groups' effects (None if not finite)."""
        curve, random, bounds = self.curve, self.random, (self.lower, self.upper, self.group_lower, self.group_upper)

        def run(batches):
            for t in whole_groups(batches):
                keys = t["g"].combine_chunks().dictionary_encode()
                keys = keys if isinstance(keys, pa.DictionaryArray) else keys.combine_chunks()
                d = nlmm.Points(t["x"].to_numpy(), t["m"].to_numpy(), t["n"].to_numpy().astype(float), 0.0, keys.indices.to_numpy().astype(np.int64), keys.dictionary.to_pylist(), t.num_rows)
                problem = nlmm.Problem(d, curve, random, False, *bounds)
                yield problem, own_effects(problem, lam, beta)

        return run

    def sums(self, lam, beta):
        """(penalised squares, log determinants, matrix and right side of the fixed effects); None if not finite."""
        k, p, random, parts = self.k, self.p, self.random, self._parts(lam, beta)
        prior = np.linalg.inv(lam @ lam.T)

        def run(batches):
            total = np.zeros(2 + p * p + p)
            for problem, out in parts(batches):
                if out is None:
                    total[:] = math.nan
                    break
                d, m = problem.d, problem.m
                at, b, value = out
                mu, grad = problem.mean(at, b)
                z, r = grad[:, random], d.y - mu
                add = lambda a: np.stack([np.bincount(d.group, a[:, j], m) for j in range(a.shape[1])], axis=1)
                zz = add((z[:, :, None] * z[:, None, :] * d.w[:, None, None]).reshape(-1, k * k)).reshape(-1, k, k)
                c = add((z[:, :, None] * grad[:, None, :] * d.w[:, None, None]).reshape(-1, k * p)).reshape(-1, k, p)
                g = add(z * (d.w * r)[:, None]) - b @ prior
                sc, sg = np.linalg.solve(zz + prior, c), np.linalg.solve(zz + prior, g[:, :, None])[:, :, 0]
                matrix = (grad * d.w[:, None]).T @ grad - np.einsum("mkp,mkq->pq", c, sc)
                right = grad.T @ (d.w * r) - np.einsum("mkp,mk->p", c, sg)
                total += np.concatenate([[value, np.linalg.slogdet(np.eye(k) + lam.T @ zz @ lam)[1].sum()], matrix.ravel(), right])
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

        total = np.sum([r["v"] for r in self.rows.mapInArrow(run, "v array<double>").collect()], axis=0)
        if not np.isfinite(total).all():
            return None
        return float(total[0]) + self.within, float(total[1]), total[2 : 2 + p * p].reshape(p, p), total[2 + p * p :]

    def solve(self, lam, beta, most: int = 60):
        """(fixed effects, sums) of least penalised squares, by damped Gauss-Newton steps."""
        beta = np.clip(beta, self.lower, self.upper)
        now, damp = self.sums(lam, beta), 0.0
        for _ in range(most if now else 0):
            value, _, a, right = now
            for _ in range(14):
                try:
                    step = np.linalg.solve(a + damp * np.diag(np.maximum(np.diag(a), 1e-8)), right)
                except np.linalg.LinAlgError:
                    damp = max(damp * 10, 1e-6)
                    continue
                new = np.clip(beta + step, self.lower, self.upper)
                # What the step promises is below what the sums can show.
                if abs(right @ (new - beta)) <= 1e-11 * (abs(value) + 1e-12):
                    return beta, now
                got = self.sums(lam, new)
                if got and got[0] < value:
                    beta, now, damp = new, got, damp * 0.1 if damp > 1e-8 else 0.0
                    break
                damp = max(damp * 10, 1e-4)
            else:
                return beta, now
        return (beta, now) if now else None

    def criterion(self, sums) -> tuple[float, float]:
        value, logdet, matrix, _ = sums
        df = self.n - self.p if self.reml else self.n
        sigma2 = value / df
        out = df * (math.log(2 * math.pi * sigma2) + 1) + logdet
        return float(out + np.linalg.slogdet(matrix)[1] if self.reml else out), sigma2

    def effects(self, lam, beta) -> tuple[list, np.ndarray]:
        """Labels in order, and each group's effects."""
        parts, k = self._parts(lam, beta), self.k

        def run(batches):
            for problem, out in parts(batches):
                yield pa.RecordBatch.from_arrays([pa.array(problem.d.labels, pa.string()), *[pa.array(out[1][:, j]) for j in range(k)]], names=["g", *[f"b{j}" for j in range(k)]])

        got = self.rows.mapInArrow(run, "g string, " + ", ".join(f"b{j} double" for j in range(k))).limit(MOST_GROUPS + 1).toArrow()
        if got.num_rows > MOST_GROUPS:
            raise ModelError(f"more than {MOST_GROUPS} groups")
        got = got.sort_by("g")
        return got["g"].to_pylist(), np.stack([got[f"b{j}"].to_numpy() for j in range(k)], axis=1)


def fit(problem: Spread, starts: list):
    """(theta, beta, sigma2, deviance, evaluations, converged): of the starts the one that is best at the first theta."""
    k = problem.k

    def at(theta, start):
        lam = nlmm.triangle(theta, k)
        lam = lam + np.diag(np.where(np.abs(np.diag(lam)) < 1e-6, 1e-6, 0.0))
        try:
            out = problem.solve(lam, start)
        except np.linalg.LinAlgError:
            out = None
        return (math.inf, None, None) if out is None else (problem.criterion(out[1])[0], out[0], out[1])

    lower = np.array([1e-6 if i == j else -np.inf for j in range(k) for i in range(j, k)])
    first = np.where(np.isfinite(lower), 1.0, 0.0)
    value, beta, _ = min((at(first, np.asarray(s, float)) for s in starts), key=lambda x: x[0])
    if not math.isfinite(value):
        raise ValueError("no start leads to a finite criterion; give start values")
    warm, count = [beta], 0

    def f(theta):
        nonlocal count
        count += 1
        value, beta, _ = at(theta, warm[0])
        if math.isfinite(value):
            warm[0] = beta
        return value

    if k == 1:
        t, value = parabola(lambda u: f(np.array([max(u, 1e-6)])), 1.0)
        theta, ok = np.array([1e-6 if f(np.array([1e-6])) <= value + 1e-10 else t]), True
    else:
        theta, _, _, ok = nelder_mead(f, first, lower, step=0.5, tol=1e-7, most=300, restarts=1)
    value, beta, sums = at(theta, warm[0])
    return theta, beta, problem.criterion(sums)[1], value, count, ok
