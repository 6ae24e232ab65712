"""glmer: families and links on compressed rows."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import families
from ..plans.design import Design, ModelError, analyze, number
from .gram import design_rows, factors_of
from .kernels import glmm
from .model import FittedModel

#: Distinct rows (response, design, groups, offset) that the driver solves on.
MOST_PATTERNS = 3_000_000


def compress(df: DataFrame, design: Design, weights: str | None = None, response: Column | None = None) -> DataFrame:
    """Distinct design rows with summed weights, their number and the sum of log weights."""
    factors, _ = factors_of(design)
    unshifted = Design(**{**design.__dict__, "shift": 0.0, "offset": None})
    rows, e = design_rows(df, unshifted, factors, weights, response, keep=(design.offset_column().alias("off"),))
    keys = [f"g{i}" for i in range(len(factors))] + [f"u{i}" for i in range(len(e.columns))] + ["off"]
    return rows.groupBy(*keys).agg(F.sum("w").alias("w"), F.count("*").alias("rows")), e


def pool(table: DataFrame, e, fam: families.Family) -> DataFrame:
    """Rows of ``compress`` that differ in the response alone as one: their weighted mean, and their deviance about it.

    A family's deviance from any mean is that of the mean response plus the deviance about it, so no fit changes.
    """
    y, weighed = f"u{e.y}", F.col("w") * F.col(f"u{e.y}")
    keys = [c for c in table.columns if c not in (y, "w", "rows")]
    # Gamma: twice the weight times the log of the mean, less the logs' sum.
    mean = F.when(F.sum("w") > 0, F.try_divide(F.sum(weighed), F.sum("w"))).otherwise(F.avg(y))
    pooled = table.groupBy(*keys).agg(F.sum("w").alias("w"), F.sum("rows").alias("rows"), mean.alias(y), F.sum(F.col("w") * F.log(y)).alias("logs"))
    return pooled.withColumn("within", F.greatest(2.0 * (F.col("w") * F.log(y) - F.col("logs")), F.lit(0.0))).drop("logs")


def _validate(df: DataFrame, design: Design, fam: families.Family, weights: str | None, response: Column | None) -> None:
    y = response if response is not None else number(design.response)
    low, high, itself = fam.valid
    bad = ~y.between(F.lit(low), F.lit(high)) if itself else ~(y > low)
    if fam.name == "binomial" and weights is not None:
        trials = number(weights)
        bad = bad | (F.abs(trials * y - F.round(trials * y)) > 1e-6 * F.greatest(trials, F.lit(1.0))) | (trials < 1) & (F.round(trials) == trials) & (trials <= 0)
    if df.where(F.coalesce(bad, F.lit(True))).limit(1).count():
        raise ModelError(f"a response that family {fam.name} doesn't allow")


def patterns(df: DataFrame, design: Design, fam: families.Family, weights: str | None = None, response: Column | None = None, pooled: bool = True) -> glmm.Patterns:
    """``pooled``: of gamma models, responses that agree in all else come as their mean."""
    factors, layout = factors_of(design)
    table, e = compress(df, design, weights, response)
    if pooled := pooled and fam.name == "gamma":
        table = pool(table, e, fam)
    # As Arrow: a Python row for each pattern would be many times as large.
    got = table.limit(MOST_PATTERNS + 1).toArrow()
    if got.num_rows > MOST_PATTERNS:
        raise ModelError(f"more than {MOST_PATTERNS} distinct rows; fit with distributed=True")
    column = lambda name: got[name].to_numpy().astype(float, copy=False)
    u = np.stack([column(f"u{i}") for i in range(len(e.columns))], axis=1)
    rows, groups = column("rows"), []
    for i, f in enumerate(factors):
        f.labels, where = _numbered(got[f"g{i}"])
        f.n = np.bincount(where, rows)
        groups.append(where)
    within = float(column("within").sum()) if pooled else 0.0
    return glmm.Patterns(u[:, e.x].reshape(len(u), len(e.x)), u[:, e.y], column("w"), column("off"), groups, [u[:, z] for z in e.z], factors, layout, design.names, int(rows.sum()), within)


def _numbered(keys) -> tuple[list, np.ndarray]:
    """The distinct keys in order, and each row's number among them."""
    coded = keys.combine_chunks().dictionary_encode()
    coded = coded if isinstance(coded, pa.DictionaryArray) else coded.combine_chunks()
    labels = coded.dictionary.to_pylist()
    order = sorted(range(len(labels)), key=labels.__getitem__)
    number = np.empty(len(labels), dtype=np.int64)
    number[order] = np.arange(len(labels))
    return [labels[k] for k in order], number[coded.indices.to_numpy()]


@dataclass
class PreparedGlmer:
    design: Design
    rows: glmm.Patterns
    family: families.Family
    link: families.Link
    n_agq: int
    data: DataFrame
    weights: str | None

    @property
    def family_name(self) -> str:
        return self.family.name

    def fit(self, refine: bool = False) -> FittedModel:
        """``refine``: fixed effects at the least deviance together with theta, not those of the penalised iterations."""
        d = self.rows
        s, theta, count, ok = glmm.fit(d, self.family, self.link, self.n_agq)
        if refine:
            s, theta, more, ok = glmm.refine(d, self.family, self.link, theta, s, self.n_agq)
            count += more
        used = glmm.order_used(d, sum(v.size for v in s.u), self.n_agq)[1] if d.layout else self.n_agq
        if used < self.n_agq:
            warnings.warn(f"n_agq={self.n_agq} has too many points for these random effects; {f'order {used} was used' if used > 1 else 'the fit is Laplace'}", stacklevel=2)
        p = d.x.shape[1]
        phi = s.phi if self.family.dispersion else None
        sigma2 = s.dev / float(d.w.sum()) if self.family.dispersion else None
        cov = [lam @ lam.T for lam in s.sol.lam]
        return FittedModel(
            design=self.design, kind="glmer", coefficients=s.beta, v_unscaled=np.linalg.inv(s.sol.s[:p, :p]), sigma2=sigma2, theta=theta, deviance=s.deviance, reml=False, num_obs=d.n,
            labels=[f.labels for f in d.factors], b=s.b, u=s.u, covariance=cov, factors=d.factors, layout=d.layout, n_params=len(theta) + p, converged=ok, iterations=count, family=self.family, link=self.link, phi=phi, data=self.data, weights=self.weights,
            log_likelihood=-s.deviance / 2, extra={"patterns": d, "n_agq": self.n_agq, "n_agq_used": used},
        )

    def with_response(self, response: Column) -> "PreparedGlmer":
        _validate(self.data, self.design, self.family, self.weights, response)
        return PreparedGlmer(self.design, patterns(self.data, self.design, self.family, self.weights, response), self.family, self.link, self.n_agq, self.data, self.weights)


def prepare_glmer(formula: str, df: DataFrame, family: str, n_agq: int = 1, weights: str | None = None, link: str | None = None) -> PreparedGlmer:
    fam = families.family(family)
    lk = families.link(fam, link)
    if n_agq not in glmm.NODES_ALLOWED:
        raise ModelError(f"n_agq is one of {glmm.NODES_ALLOWED}")
    design = analyze(df, formula)
    design.shift = 0.0
    if not design.random:
        raise ModelError("a formula without random terms")
    _validate(df, design, fam, weights, None)
    return PreparedGlmer(design, patterns(df, design, fam, weights), fam, lk, n_agq, df, weights)


def glmer(formula: str, df: DataFrame, family: str, n_agq: int = 1, link: str | None = None, weights: str | None = None, distributed: bool = False, refine: bool = False) -> FittedModel:
    """A generalized linear mixed model; gaussian with the identity link is lmer by maximum likelihood.

    ``distributed``: more distinct rows than the driver can hold; every iteration is a pass over them.
    """
    fam = families.family(family)
    if distributed:
        from .distributed import glmer_distributed

        return glmer_distributed(formula, df, family, link, weights)
    if fam.name == "gaussian" and families.link(fam, link).name == "identity":
        from .linear import lmer

        return lmer(formula, df, reml=False, weights=weights)
    return prepare_glmer(formula, df, family, n_agq, weights, link).fit(refine)


glmer_weighted = glmer_with_link = glmer


def fit_prepared_glmer(prepared: PreparedGlmer) -> FittedModel:
    return prepared.fit()
