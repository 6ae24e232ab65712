"""Tests and intervals for fixed effects, from the stored cross-products alone."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import special
from ..plans.design import ModelError
from .kernels import lmm
from .model import ConfidenceIntervals, FittedModel

#: Denominator degrees of freedom are reported up to this.
MOST_DF = 3000.0
_STEP = 1e-4


def _parms(model: FittedModel, parms) -> list[int]:
    names = model.fixed_names
    if parms is None:
        return list(range(len(names)))
    out = []
    for p in parms:
        if isinstance(p, str) and p not in names or not isinstance(p, str) and not 0 <= int(p) < len(names):
            raise ModelError(f"no coefficient {p!r}; the model has {names}")
        out.append(names.index(p) if isinstance(p, str) else int(p))
    return out


def wald(model: FittedModel, level: float = 0.95, parms=None) -> ConfidenceIntervals:
    """t with Kenward-Roger, else Satterthwaite degrees of freedom if attached, else normal."""
    if not 0 < level < 1:
        raise ModelError("level is between 0 and 1")
    dfs = model.kenward_roger_dfs if model.kenward_roger_dfs is not None else model.satterthwaite_dfs
    if dfs is None and model.kind == "lm":
        dfs = np.full(len(model.coefficients), float(model.num_obs - len(model.coefficients)))
    at, p = _parms(model, parms), 1 - (1 - level) / 2
    q = [special.norm_ppf(p) if dfs is None else special.t_ppf(p, dfs[k]) for k in at]
    half = [q_ * model.beta_se[k] for q_, k in zip(q, at)]
    return ConfidenceIntervals([model.fixed_names[k] for k in at], [model.coefficients[k] - h for k, h in zip(at, half)], [model.coefficients[k] + h for k, h in zip(at, half)], level)


# ------------------------------------------- uncertainty of the variances


def _needs_gram(model: FittedModel, what: str) -> None:
    if model.kind != "lmer" or model.gram is None:
        raise ModelError(f"{what} is for linear mixed models fitted in this session")


class Variances:
    """Unprofiled deviance in (theta, sigma^2) and how Phi = sigma^2 (X'V^-1 X)^-1 moves with them."""

    def __init__(self, model: FittedModel):
        g, reml, theta = model.gram, model.reml, model.theta
        p, df = g.p, g.n - g.p if model.reml else g.n
        rho = np.concatenate([theta, [model.sigma2]])
        steps = np.array([*[_STEP] * len(theta), _STEP * max(model.sigma2, 1e-4)])

        def parts(th):
            s = lmm.Solution(g, th)
            sx = s.s[:p, :p]
            rss = s.s[p, p] - s.s[:p, p] @ np.linalg.solve(sx, s.s[:p, p])
            return rss, s.logdet + (np.linalg.slogdet(sx)[1] if reml else 0.0), np.linalg.inv(sx)

        def dev(r):
            rss, logs, _ = parts(r[:-1])
            return df * math.log(2 * math.pi * r[-1]) + logs + rss / r[-1]

        n = len(rho)
        e = np.eye(n) * steps
        h = np.zeros((n, n))
        f0 = dev(rho)
        for i in range(n):
            h[i, i] = (dev(rho + e[i]) - 2 * f0 + dev(rho - e[i])) / steps[i] ** 2
            for j in range(i + 1, n):
                h[i, j] = h[j, i] = (dev(rho + e[i] + e[j]) - dev(rho + e[i] - e[j]) - dev(rho - e[i] + e[j]) + dev(rho - e[i] - e[j])) / (4 * steps[i] * steps[j])
        self.a = 2 * np.linalg.pinv(h) if np.linalg.cond(h) > 1e14 else 2 * np.linalg.inv(h)
        phi = lambda r: parts(r[:-1])[2] * r[-1]
        self.phi = phi(rho)
        self.jacobian = [(phi(rho + e[i]) - phi(rho - e[i])) / (2 * steps[i]) for i in range(n)]

    def df(self, c: np.ndarray) -> float:
        """Satterthwaite's for one contrast: twice the squared variance over the variance's variance."""
        v, grad = c @ self.phi @ c, np.array([c @ j @ c for j in self.jacobian])
        denominator = grad @ self.a @ grad
        return 2 * v * v / denominator if denominator > 1e-12 else math.nan


def _variances(model: FittedModel) -> Variances:
    if "variances" not in model.extra:
        model.extra["variances"] = Variances(model)
    return model.extra["variances"]


def _bounded_df(df: float, fallback: float) -> float:
    return fallback if math.isnan(df) or df <= 0 else min(df, MOST_DF)


def satterthwaite(model: FittedModel) -> dict:
    _needs_gram(model, "Satterthwaite's approximation")
    v, p = _variances(model), len(model.coefficients)
    dfs = np.array([_bounded_df(v.df(c), model.num_obs - p) for c in np.eye(p)])
    return {"dfs": dfs, "p_values": np.array([special.t_two_sided(t, d) for t, d in zip(model.beta_t, dfs)])}


# -------------------------------------------------------------- Kenward-Roger


def _kr_parts(model: FittedModel):
    """Phi, adjusted Phi, P_r and W, by sums over groups: no n x n matrix is formed.

    V = sum of gamma_r G_r with G_r = Z E_r Z' and the identity last.  By
    Woodbury Z'V^-1 = K Z' with K = (I - S M) / sigma^2, S = Z'Z and
    M = L (L'SL + I)^-1 L', so all traces and products are of group size (one
    grouping) or of the number of random effects (several).
    """
    g, s2, lams = model.gram, model.sigma2, lmm.lambdas(model.theta, model.gram)
    p, xx = g.p, g.t[: g.p, : g.p]
    if len(g.factors) == 1:
        f, k = g.factors[0], len(g.factors[0].effects)
        s, zx, lam = f.s, f.c[:, :, :p], lams[0]
        bases = [e[None] for e in _bases(g.layout, 0, k)]
    else:
        sizes = [f.s.shape[0] * len(f.effects) for f in g.factors]
        at = np.concatenate([[0], np.cumsum(sizes)])
        q = int(at[-1])
        if q > 3000:
            raise ModelError("Kenward-Roger with several groupings needs at most 3000 random effects; use Satterthwaite")
        s, zx, lam, bases = np.zeros((1, q, q)), np.zeros((1, q, p)), np.zeros((q, q)), []
        for i, f in enumerate(g.factors):
            m, k = f.s.shape[0], len(f.effects)
            rows = at[i] + np.arange(m)[:, None] * k + np.arange(k)
            s[0][rows[:, :, None], rows[:, None, :]] = f.s
            zx[0][at[i] : at[i + 1]] = f.c[:, :, :p].reshape(m * k, p)
            lam[at[i] : at[i + 1], at[i] : at[i + 1]] = np.kron(np.eye(m), lams[i])
            for j in range(i + 1, len(g.factors)):
                u, v, z = g.cross[(i, j)]
                r, c = at[i] + u[:, None] * k + np.arange(k), at[j] + v[:, None] * len(g.factors[j].effects) + np.arange(len(g.factors[j].effects))
                s[0][r[:, :, None], c[:, None, :]] = z
                s[0][c[:, :, None], r[:, None, :]] = z.transpose(0, 2, 1)
        full = []
        for fi, first, kk, _ in g.layout:
            m, k = g.factors[fi].s.shape[0], len(g.factors[fi].effects)
            for e in _block_bases(first, kk, k):
                b = np.zeros((q, q))
                b[at[fi] : at[fi + 1], at[fi] : at[fi + 1]] = np.kron(np.eye(m), e)
                full.append(b[None])
        bases = full
    size = s.shape[1]
    m_ = lam @ np.linalg.solve(lam.T @ s @ lam + np.eye(size), np.broadcast_to(lam.T, s.shape))
    kt = (np.eye(size) - s @ m_) / s2
    a = kt @ zx  # Z'V^-1 X
    ks = kt @ s  # Z'V^-1 Z
    t = lambda x: x.transpose(0, 2, 1)
    x2 = (xx - 2 * np.einsum("mkp,mkl,mlq->pq", zx, m_, zx) + (t(m_ @ zx) @ s @ m_ @ zx).sum(0)) / s2**2  # X'V^-2 X
    ka = kt @ a  # Z'V^-2 X
    x3 = (x2 - (t(zx) @ m_ @ ka).sum(0)) / s2  # X'V^-3 X
    n_r = len(bases) + 1
    pp = [-(t(a) @ e @ a).sum(0) for e in bases] + [-x2]
    qq, kk2 = {}, np.zeros((n_r, n_r))
    for r, e in enumerate(bases):
        for c, e2 in enumerate(bases[r:], r):
            qq[r, c] = (t(a) @ e @ ks @ e2 @ a).sum(0)
            kk2[r, c] = kk2[c, r] = np.einsum("mij,mji->", e @ ks, e2 @ ks)
        qq[r, n_r - 1] = (t(a) @ e @ ka).sum(0)
        kk2[r, n_r - 1] = kk2[n_r - 1, r] = np.einsum("mij,mji->", np.broadcast_to(e, ks.shape), kt @ ks)
    qq[n_r - 1, n_r - 1] = x3
    sm = s @ m_
    kk2[-1, -1] = (g.n - 2 * np.einsum("mii->", sm) + np.einsum("mij,mji->", sm, sm)) / s2**2
    phi = model.vcov
    info = np.zeros((n_r, n_r))
    for r in range(n_r):
        for c in range(r, n_r):
            info[r, c] = info[c, r] = kk2[r, c] - 2 * (phi * qq[r, c]).sum() + ((phi @ pp[r]) * (pp[c] @ phi)).sum()
    w = 2 * np.linalg.inv(info if np.abs(np.linalg.eigvalsh(info)).min() > 1e-10 else info + 1e-8 * np.eye(n_r))
    u = np.zeros((p, p))
    for r in range(n_r):
        for c in range(r, n_r):
            term = w[r, c] * (qq[r, c] - pp[r] @ phi @ pp[c])
            u += term if r == c else term + term.T
    return phi, phi + 2 * phi @ u @ phi, pp, w


def _block_bases(first: int, k: int, total: int) -> list[np.ndarray]:
    out = []
    for j in range(k):
        for i in range(j, k):
            e = np.zeros((total, total))
            e[first + i, first + j] = e[first + j, first + i] = 1.0
            out.append(e)
    return out


def _bases(layout, factor: int, total: int) -> list[np.ndarray]:
    return [e for f, first, k, _ in layout if f == factor for e in _block_bases(first, k, total)]


def _kr(model: FittedModel):
    if "kr" not in model.extra:
        _needs_gram(model, "Kenward-Roger's approximation")
        model.extra["kr"] = _kr_parts(model)
    return model.extra["kr"]


def kenward_roger(model: FittedModel) -> dict:
    """Degrees of freedom by coefficient, p-values with adjusted standard errors."""
    phi, adjusted, _, _ = _kr(model)
    v, p = _variances(model), len(model.coefficients)
    dfs = np.array([_bounded_df(v.df(c), model.num_obs - p) for c in np.eye(p)])
    se = np.sqrt(np.maximum(np.diag(adjusted), 0))
    return {"dfs": dfs, "p_values": np.array([special.t_two_sided(b / s, d) if s > 0 else math.nan for b, s, d in zip(model.coefficients, se, dfs)]), "vcov": adjusted}


def _kr_test(model: FittedModel, l, diff):  # noqa: E741
    """F, denominator degrees of freedom: Kenward and Roger's scaled Wald test."""
    phi, adjusted, pp, w = _kr(model)
    q = np.linalg.matrix_rank(l)
    if np.allclose(phi, adjusted, rtol=1e-8, atol=0) and not diff[1]:
        dfs = model.extra.setdefault("kenward_roger", kenward_roger(model))["dfs"]
        used = [dfs[j] for j in range(l.shape[1]) if np.abs(l[:, j]).max() > 1e-12]
        return _wald(l, phi, diff[0]) / q, _pooled(used), q
    theta = l.T @ np.linalg.solve(l @ phi @ l.T, l)
    us = [theta @ phi @ p @ phi for p in pp]
    a1 = sum(w[i, j] * np.trace(us[i]) * np.trace(us[j]) for i in range(len(pp)) for j in range(len(pp)))
    a2 = sum(w[i, j] * np.trace(us[i] @ us[j]) for i in range(len(pp)) for j in range(len(pp)))
    b = (a1 + 6 * a2) / (2 * q)
    g = ((q + 1) * a1 - (q + 4) * a2) / ((q + 2) * a2) if abs(a2) > 1e-15 else 0.0
    c = 3 * q + 2 * (1 - g)
    tidy = lambda x: 0.0 if abs(x) < 1e-10 else x
    v0, v1, v2 = tidy(1 + g / c * b), 1 - (q - g) / c * b, tidy(1 - (q + 2 - g) / c * b)
    ratio = lambda x, y: 1.0 if abs(x) < 1e-10 and abs(y) < 1e-10 else x / y
    rho = ratio(1 - a2 / q, v1) ** 2 * ratio(v0, v2) / q
    df = 4 + (q + 2) / (q * rho - 1) if abs(q * rho - 1) > 1e-12 else math.nan
    scale = 1.0 if abs(df - 2) < 1e-2 else df * (1 - a2 / q) / (df - 2)
    return scale * _wald(l, phi, diff[0]) / q, df if df > 0 else math.nan, q


def _wald(l, v, d) -> float:  # noqa: E741
    return float((l @ d) @ np.linalg.pinv(l @ v @ l.T) @ (l @ d))


def _pooled(nu: list) -> float:
    """Degrees of freedom of a mean of squared t statistics."""
    if any(math.isnan(v) for v in nu):
        return math.nan
    if max(nu) - min(nu) < 1e-8:
        return nu[0]
    if min(nu) <= 2:
        return 2.0
    e = sum(v / (v - 2) for v in nu)
    return 2 * e / (e - len(nu))


# --------------------------------------------------------------------- robust


def robust(model: FittedModel, data: DataFrame, cluster: str | None = None) -> dict:
    """Sandwich errors: scores by row (HC0) or summed by cluster (CR0), then one sum of outer products."""
    df = model.fitted(data)
    p = len(model.coefficients)
    w = F.lit(1.0) if model.weights is None else F.col(f"`{model.weights}`").cast("double")
    scores = df.select(*([F.coalesce(F.col(f"`{cluster}`").cast("string"), F.lit("")).alias("g")] if cluster else []), *[(c.column() * w * F.col("residual")).alias(f"s{j}") for j, c in enumerate(model.design.columns)])
    if cluster:
        scores = scores.groupBy("g").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(p)])
    got = scores.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(p) for j in range(i, p)]).first()
    meat = np.array([[got[f"m{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float)
    v = model.v_unscaled @ meat @ model.v_unscaled
    se = np.sqrt(np.diag(v))
    t = model.coefficients / se
    return {"vcov": v, "se": se, "t": t, "p_values": np.array([special.norm_two_sided(z) for z in t])}


# ------------------------------------------------------------------ contrasts


@dataclass
class ContrastTest:
    method: str
    num_df: float
    den_df: float
    f_value: float
    p_value: float

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.method, float(self.num_df), float(self.den_df), float(self.f_value), float(self.p_value))], "method string, num_df double, den_df double, f_value double, p_value double")


def contrast_matrix(p: int, rows: list) -> np.ndarray:
    """Rows of (column, value) pairs as a matrix."""
    out = np.zeros((len(rows), p))
    for r, row in enumerate(rows):
        for k, v in row:
            if not 0 <= k < p:
                raise ModelError(f"column {k} of {p}")
            out[r, k] = v
    return out


def contrast_matrix_from_names(names: list[str], rows: list) -> np.ndarray:
    unknown = {n for row in rows for n, _ in row} - set(names)
    if unknown:
        raise ModelError(f"no coefficients {sorted(unknown)}")
    return contrast_matrix(len(names), [[(names.index(n), v) for n, v in row] for row in rows])


def test_contrast(model: FittedModel, l_matrix, beta_h=None, ddf_method: str = "satterthwaite") -> ContrastTest:
    """L beta = L beta_h; a robust covariance, if attached, is used for every contrast."""
    l = np.atleast_2d(np.asarray(l_matrix, float))  # noqa: E741
    p = len(model.coefficients)
    if l.shape[1] != p:
        raise ModelError(f"contrasts of {l.shape[1]} columns for {p} coefficients")
    diff = model.coefficients - (np.zeros(p) if beta_h is None else np.asarray(beta_h, float))
    q = int(np.linalg.matrix_rank(l))
    method = ddf_method.lower().replace("-", "_")
    if q == 0:
        return ContrastTest(method, 0, math.nan, math.nan, math.nan)
    if "robust" in model.extra:
        f = _wald(l, model.extra["robust"]["vcov"], diff) / q
        return ContrastTest("robust", q, math.inf, f, special.chi2_sf(f * q, q))
    if model.kind == "glmer" or method in ("wald", "z", "none"):
        f = _wald(l, model.vcov, diff) / q
        return ContrastTest("wald", q, math.inf, f, special.chi2_sf(f * q, q))
    if model.kind == "lm":
        f, df = _wald(l, model.vcov, diff) / q, float(model.num_obs - p)
        return ContrastTest("residual", q, df, f, special.f_sf(f, q, df))
    if method == "kenward_roger":
        f, df, q = _kr_test(model, l, (diff, beta_h is not None))
        return ContrastTest(method, q, df, f, special.f_sf(f, q, df))
    if method != "satterthwaite":
        raise ModelError(f"unknown method {ddf_method!r}: satterthwaite, kenward_roger or wald")
    _needs_gram(model, "Satterthwaite's approximation")
    v = _variances(model)
    values, vectors = np.linalg.eigh(l @ v.phi @ l.T)
    keep = values > math.sqrt(2.2e-16) * values.max()
    t2 = [(vectors[:, k] @ l @ diff) ** 2 / values[k] for k in np.flatnonzero(keep)]
    nu = [v.df(vectors[:, k] @ l) for k in np.flatnonzero(keep)]
    nu = [min(x, MOST_DF) if x > 0 else math.nan for x in nu] if len(nu) > 1 else nu
    f, df = float(np.mean(t2)), _pooled(nu)
    return ContrastTest(method, len(t2), df, f, special.f_sf(f, len(t2), df))


# ---------------------------------------------------------------------- anova


@dataclass
class FixedEffectsAnova:
    anova_type: str
    method: str
    terms: list
    num_df: list
    den_df: list
    f_value: list
    p_value: list

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t, *map(float, r)) for t, *r in zip(self.terms, self.num_df, self.den_df, self.f_value, self.p_value)], "term string, num_df double, den_df double, f_value double, p_value double")


def term_contrasts(model: FittedModel, anova_type: str) -> dict:
    """Contrasts of each term.  I: sequential.  II: beside all terms that don't contain it.  III: its own columns."""
    kind = {"1": "I", "2": "II", "3": "III"}.get(str(anova_type), str(anova_type).upper())
    if kind not in ("I", "II", "III"):
        raise ModelError(f"unknown type {anova_type!r}: I, II or III")
    terms, p = model.design.terms, len(model.coefficients)
    order = [t for t in dict.fromkeys(terms) if t != "(Intercept)"]
    eye = np.eye(p)
    columns = {t: [k for k, x in enumerate(terms) if x == t] for t in order}
    if kind == "III":
        return {t: eye[columns[t]] for t in order}
    xx = model.gram.t[:p, :p] if model.gram is not None else None
    if xx is None:
        raise ModelError("types I and II need a model fitted in this session")
    out = {}
    for t in order:
        after = order[order.index(t) + 1 :] if kind == "I" else [o for o in order if set(t.split(":")) < set(o.split(":"))]
        own, last = columns[t], [k for o in after for k in columns[o]]
        first = [k for k in range(p) if k not in own and k not in last]
        # What the term's columns, freed of the earlier ones, estimate: rows of a forward elimination.
        full = first + own + last
        m = xx[np.ix_(full, full)]
        n1, n2 = len(first), len(own)
        s = m[n1:, n1:] - m[n1:, :n1] @ np.linalg.pinv(m[:n1, :n1]) @ m[:n1, n1:] if n1 else m
        l = np.zeros((n2, p))  # noqa: E741
        l[:, own] = np.eye(n2)
        if last:
            l[:, last] = np.linalg.solve(s[:n2, :n2], s[:n2, n2:])
        out[t] = l
    return out


def anova_terms(model: FittedModel, ddf_method: str = "satterthwaite", anova_type: str = "III") -> FixedEffectsAnova:
    tests = {t: test_contrast(model, l, None, ddf_method) for t, l in term_contrasts(model, anova_type).items()}
    return FixedEffectsAnova(str(anova_type), ddf_method, list(tests), *[[getattr(t, f) for t in tests.values()] for f in ("num_df", "den_df", "f_value", "p_value")])


@dataclass
class LikelihoodRatioAnova:
    n_params_0: int
    n_params_1: int
    deviance_0: float
    deviance_1: float
    chi_sq: float
    df: int
    p_value: float
    formula_0: str
    formula_1: str

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.formula_0, self.formula_1, float(self.deviance_0), float(self.deviance_1), float(self.chi_sq), int(self.df), float(self.p_value))], "formula_0 string, formula_1 string, deviance_0 double, deviance_1 double, chi_sq double, df int, p_value double")


def anova(a: FittedModel, b: FittedModel) -> LikelihoodRatioAnova:
    """Likelihood ratio of nested fits of the same rows."""
    if a.num_obs != b.num_obs:
        raise ModelError("models of different numbers of rows")
    if a.n_params == b.n_params:
        raise ModelError("models with as many parameters")
    if (a.reml or b.reml) and a.fixed_names != b.fixed_names:
        warnings.warn("REML criteria of different fixed effects don't compare; fit with reml=False", stacklevel=2)
    a, b = sorted((a, b), key=lambda m: m.n_params)
    da, db = -2 * a.log_likelihood, -2 * b.log_likelihood
    chi, df = max(0.0, da - db), b.n_params - a.n_params
    return LikelihoodRatioAnova(a.n_params, b.n_params, da, db, chi, df, special.chi2_sf(chi, df), a.formula, b.formula)
