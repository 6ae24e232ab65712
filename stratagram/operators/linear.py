"""lm, lmer: formula and table to fitted model."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.design import Design, ModelError, analyze
from .gram import Gram, build_gram, design_rows, factors_of
from .kernels import lmm
from .model import FittedModel


def _assemble(design: Design, gram: Gram, fit: lmm.LmmFit, kind: str, count: int, ok: bool, data, weights) -> FittedModel:
    beta = fit.beta.copy()
    if design.shift:
        beta[design.names.index("(Intercept)")] += design.shift
    p, n = gram.p, gram.n
    if kind == "lm":
        df = n - p
        sigma2 = fit.rss / df if df > 0 else None
        loglik = -0.5 * n * math.log(2 * math.pi * sigma2) - fit.rss / (2 * sigma2) if sigma2 else math.nan
        n_params, dev = p + 1, fit.rss
    else:
        sigma2, loglik, n_params, dev = fit.sigma2, -fit.deviance / 2, len(fit.theta) + p + 1, fit.deviance
    return FittedModel(
        design=design, kind=kind, coefficients=beta, v_unscaled=fit.v_unscaled, sigma2=sigma2, theta=fit.theta, deviance=dev, reml=fit.reml and kind == "lmer", num_obs=n,
        labels=[f.labels for f in gram.factors], b=fit.b, u=fit.u, covariance=fit.covariance, factors=gram.factors, layout=gram.layout, n_params=n_params, converged=ok, iterations=count, gram=gram, data=data, weights=weights, log_likelihood=loglik,
    )


def lm(formula: str, df: DataFrame, weights: str | None = None) -> FittedModel:
    """Ordinary (or weighted) least squares by normal equations from one aggregate."""
    design = analyze(df, formula)
    if design.random:
        raise ModelError("a formula with random terms; use lmer")
    gram = build_gram(df, design, weights)
    if gram.n < gram.p:
        raise lmm.Singular(f"{gram.n} rows for {gram.p} coefficients")
    if gram.n == gram.p:
        lmm.check_rank(gram)
        v = np.linalg.inv(gram.t[: gram.p, : gram.p])
        fit = lmm.LmmFit.of(theta=np.zeros(0), reml=False, v_unscaled=v, beta=v @ gram.t[: gram.p, gram.p], rss=0.0, u=[], b=[], covariance=[])
        return _assemble(design, gram, fit, "lm", 0, True, df, weights)
    fit, _, _ = lmm.fit(gram, reml=False)
    return _assemble(design, gram, fit, "lm", 0, True, df, weights)


def lm_matrix(y, x) -> dict:
    """Least squares of a response on the columns of a matrix, both in memory."""
    y, x = np.asarray(y, float), np.asarray(x, float)
    n, p = x.shape
    if n < p:
        raise lmm.Singular(f"{n} rows for {p} coefficients")
    q, r = np.linalg.qr(x)
    if np.abs(np.diag(r)).min() < 1e-12 * max(1.0, np.abs(np.diag(r)).max()):
        raise lmm.Singular("the columns are linearly dependent")
    beta = np.linalg.solve(r, q.T @ y)
    fitted = x @ beta
    return {"coefficients": beta, "fitted": fitted, "residuals": y - fitted, "sigma2": float(((y - fitted) ** 2).sum() / (n - p)) if n > p else None}


@dataclass
class PreparedLmer:
    """Design and cross-products of a table; fits need no further pass over it."""

    design: Design
    gram: Gram
    data: DataFrame
    weights: str | None

    @property
    def blocked_kernel(self) -> bool:
        """Whether several groupings are eliminated in blocks."""
        return len(self.gram.factors) > 1

    @property
    def blocked_kernel_detail(self) -> str:
        sizes = sorted(((f.s.shape[0] * len(f.effects), ":".join(f.group)) for f in self.gram.factors), reverse=True)
        rest = sum(n for n, _ in sizes[1:])
        return f"{sizes[0][1]} group by group ({sizes[0][0]} effects)" + (f", then {rest} effects of {', '.join(g for _, g in sizes[1:])} together" if rest else "")

    def fit(self, reml: bool = True, start=None) -> FittedModel:
        fit, count, ok = lmm.fit(self.gram, reml, start)
        return _assemble(self.design, self.gram, fit, "lmer", count, ok, self.data, self.weights)

    def with_response(self, response: Column) -> "PreparedLmer":
        """Another response on the same rows: one pass for its products with the design."""
        gram = build_gram(self.data, self.design, self.weights, response)
        return PreparedLmer(self.design, gram, self.data, self.weights)


def prepare_lmer(formula: str, df: DataFrame, weights: str | None = None) -> PreparedLmer:
    design = analyze(df, formula)
    if not design.random:
        raise ModelError("a formula without random terms; use lm")
    return PreparedLmer(design, build_gram(df, design, weights), df, weights)


def fit_prepared(prepared: PreparedLmer, reml: bool = True) -> FittedModel:
    return prepared.fit(reml)


def lmer(formula: str, df: DataFrame, reml: bool = True, weights: str | None = None, distributed_profile: bool = False) -> FittedModel:
    """A linear mixed model.  ``distributed_profile``: one grouping with more groups than the driver can hold."""
    if distributed_profile:
        from .distributed import lmer_distributed

        return lmer_distributed(formula, df, reml, weights)
    return prepare_lmer(formula, df, weights).fit(reml)


def lmer_weighted(formula: str, df: DataFrame, weights: str, reml: bool = True) -> FittedModel:
    return lmer(formula, df, reml, weights)


def refit_lmer(formula: str, df: DataFrame, reml: bool = True) -> FittedModel:
    return lmer(formula, df, reml)


def design_table(df: DataFrame, design: Design, *keep: str) -> DataFrame:
    """The encoded fixed-effects columns by name, and the response, beside ``keep``."""
    taken = df.select(*keep, *[c.column().alias(c.name) for c in design.columns], F.col(f"`{design.response}`").cast("double").alias(f"response_{design.response}"))
    return taken


__all__ = ["PreparedLmer", "design_rows", "design_table", "factors_of", "fit_prepared", "lm", "lm_matrix", "lmer", "lmer_weighted", "prepare_lmer", "refit_lmer"]
