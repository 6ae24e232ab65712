"""nlmer: nonlinear mixed models; and independent curves by key."""

from __future__ import annotations

import math
import re
import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.curves import CURVES, Curve, custom_curve
from ..plans.design import ModelError, group_key, number
from ..plans.formula import FormulaError
from ..shipping import ship
from . import spread
from .kernels import nlmm

_NAME = r"[A-Za-z_][A-Za-z0-9_]*"
_THREE = re.compile(rf"\s*({_NAME})\s*~\s*(?:({_NAME})\s*\(\s*({_NAME}(?:\s*,\s*{_NAME})+)\s*\)|({_NAME}))\s*~\s*({_NAME}(?:\s*\+\s*{_NAME})*)\s*\|\s*({_NAME})\s*")
#: Distinct (group, x) that the driver solves on where it must: for quadrature and refined fits.
MOST_POINTS = 3_000_000
#: Beyond so many distinct (group, x) other fits leave them in Spark.
MOST_LOCAL = 200_000


@dataclass
class NlFormula:
    text: str
    response: str
    curve: str | None
    x: str
    parameters: list
    random: list
    group: str


def parse_nlmer(text: str, parameters: list[str] | None = None) -> NlFormula:
    """``y ~ SSlogis(x, Asym, xmid, scal) ~ Asym + xmid | g``; with a custom mean ``y ~ x ~ p | g``."""
    m = _THREE.fullmatch(text)
    if not m:
        raise FormulaError("a nonlinear formula reads y ~ curve(x, parameters) ~ random | group")
    random = [v.strip() for v in m[5].split("+")]
    if m[2]:
        args = [v.strip() for v in m[3].split(",")]
        if m[2] not in CURVES:
            raise FormulaError(f"unknown curve {m[2]}; one of {sorted(CURVES)}")
        if len(args) - 1 != len(CURVES[m[2]].parameters):
            raise FormulaError(f"{m[2]} has parameters {CURVES[m[2]].parameters}")
        x, names, curve = args[0], args[1:], m[2]
    else:
        if parameters is None:
            raise FormulaError("a formula without a curve needs a mean function")
        x, names, curve = m[4], list(parameters), None
    if set(random) - set(names) or len(set(random)) < len(random) or len(set(names)) < len(names):
        raise FormulaError(f"random parameters {random} of {names}")
    return NlFormula(text, m[1], curve, x, names, random, m[6])


@dataclass
class NonlinearModel:
    formula: str
    spec: NlFormula
    curve: Curve
    coefficients: np.ndarray
    theta: np.ndarray
    b: np.ndarray
    labels: list
    sigma2: float
    deviance: float
    num_obs: int
    reml: bool
    converged: bool
    iterations: int
    data: DataFrame | None = None
    beta_se: None = None
    extra: dict = field(default_factory=dict)
    family_name: str = "nlmm"

    @property
    def fixed_names(self) -> list[str]:
        return self.spec.parameters

    @property
    def log_likelihood(self) -> float:
        return -self.deviance / 2

    @property
    def n_params(self) -> int:
        return len(self.coefficients) + len(self.theta) + 1

    @property
    def aic(self) -> float:
        return self.deviance + 2 * self.n_params

    @property
    def bic(self) -> float:
        return self.deviance + self.n_params * math.log(self.num_obs)

    @property
    def covariance(self) -> np.ndarray:
        lam = nlmm.triangle(self.theta, len(self.spec.random))
        return lam @ lam.T * self.sigma2

    def ranef(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.spec.group, v, p, float(self.b[i, j])) for j, p in enumerate(self.spec.random) for i, v in enumerate(self.labels)], "grouping string, group string, effect string, value double")

    def var_corr(self, spark: SparkSession) -> DataFrame:
        cov, r = self.covariance, self.spec.random
        rows = []
        for j in range(len(r)):
            for i in range(j, len(r)):
                sd = math.sqrt(cov[i, i] * cov[j, j])
                rows.append((self.spec.group, r[j], r[i], float(cov[i, j]), math.sqrt(cov[i, i]) if i == j else None, None if i == j else float(cov[i, j] / sd) if sd else None))
        rows.append(("Residual", "", "", float(self.sigma2), math.sqrt(self.sigma2), None))
        return spark.createDataFrame(rows, "grouping string, effect1 string, effect2 string, variance double, std_dev double, corr double")

    def _mean(self, df: DataFrame, params: list[Column], name: str) -> DataFrame:
        x = number(self.spec.x)
        if self.spec.curve:
            return df.withColumn(name, self.curve.column(x, params)[0])
        curve = self.curve

        @F.pandas_udf("double")
        def run(x: pd.Series, *p: pd.Series) -> pd.Series:
            return pd.Series(curve.values(x.to_numpy(), [v.to_numpy() for v in p])[0])

        return df.withColumn(name, run(x, *params))

    def predict(self, newdata: DataFrame, name: str = "prediction") -> DataFrame:
        """The population's curve."""
        return self._mean(newdata, [F.lit(float(v)) for v in self.coefficients], name)

    def predict_conditional(self, newdata: DataFrame, allow_new_levels: bool = False, name: str = "prediction") -> DataFrame:
        """Each group's curve: its effects are added to the parameters."""
        names = [f"__b{j}" for j in range(len(self.spec.random))]
        table = newdata.sparkSession.createDataFrame([(v, *map(float, row)) for v, row in zip(self.labels, self.b)], ", ".join(["__g string", *[f"{n} double" for n in names]]))
        table = F.broadcast(table) if len(self.labels) <= 500_000 else table
        df = newdata.withColumn("__k", group_key((self.spec.group,))).join(table, F.col("__k") == F.col("__g"), "left")
        other = F.lit(0.0) if allow_new_levels else F.raise_error(F.concat(F.lit("a group that the model doesn't know: "), F.col("__k"))).cast("double")
        params = [F.lit(float(v)) for v in self.coefficients]
        for n, r in zip(names, self.spec.random):
            k = self.spec.parameters.index(r)
            params[k] = params[k] + F.coalesce(F.col(n), other)
        return self._mean(df, params, name).drop("__k", "__g", *names)

    def fitted(self, data: DataFrame | None = None) -> DataFrame:
        df = self.predict_conditional(data if data is not None else self.data, name="fitted")
        return df.withColumn("residual", F.col(f"`{self.spec.response}`").cast("double") - F.col("fitted"))

    def summary(self) -> str:
        lines = ["Nonlinear mixed model fit by " + ("REML" if self.reml else "maximum likelihood"), f"Formula: {self.formula}", f"logLik {self.log_likelihood:.4f}  AIC {self.aic:.3f}  BIC {self.bic:.3f}"]
        return "\n".join(lines + [f"  {n:<12}{v:14.6f}" for n, v in zip(self.fixed_names, self.coefficients)] + [f"sigma^2 {self.sigma2:.6f}"])


def point_rows(df: DataFrame, spec: NlFormula) -> DataFrame:
    """(g, x, n, m, v): distinct (group, x) with count, mean and squares within: what normal errors need of the rows."""
    ship(df.sparkSession)
    rows = df.select(group_key((spec.group,)).alias("g"), number(spec.x).alias("x"), number(spec.response).alias("y"))
    return rows.groupBy("g", "x").agg(F.count("*").alias("n"), F.avg("y").alias("m"), (F.var_pop("y") * F.count("*")).alias("v"))


def points(df: DataFrame, spec: NlFormula, rows: DataFrame | None = None) -> nlmm.Points:
    """The points on the driver; ``rows``: those of ``point_rows``, if they are at hand."""
    got = (point_rows(df, spec) if rows is None else rows).limit(MOST_POINTS + 1).toArrow().to_pandas()
    if len(got) > MOST_POINTS:
        raise ModelError(f"more than {MOST_POINTS} distinct (group, x)")
    got = got.sort_values(["g", "x"], kind="stable")
    labels, group = np.unique(got["g"].to_numpy(str), return_inverse=True)
    return nlmm.Points(got["x"].to_numpy(float), got["m"].to_numpy(float), got["n"].to_numpy(float), float(got["v"].sum()), group, labels.tolist(), int(got["n"].sum()))


def _bounds(names, given, fill):
    out = np.full(len(names), fill)
    for k, v in (given or {}).items():
        if k not in names:
            raise ModelError(f"a bound for {k}; the parameters are {names}")
        out[names.index(k)] = v
    return out


def _fit(df, spec: NlFormula, curve: Curve, start, reml, n_agq, lower, upper, group_lower, group_upper, refine) -> NonlinearModel:
    for given in (group_lower, group_upper):
        if set(given or {}) - set(spec.random):
            raise ModelError(f"group bounds are for random parameters {spec.random}")
    names = spec.parameters
    lo, hi = _bounds(names, lower, -np.inf), _bounds(names, upper, np.inf)
    if (lo > hi).any():
        raise ModelError("a lower bound above its upper bound")
    random, own_lo, own_hi = [names.index(r) for r in spec.random], _bounds(names, group_lower, -np.inf), _bounds(names, group_upper, np.inf)
    used = nlmm.grid_order(n_agq, len(spec.random), nlmm.MOST_GRID)
    if used < n_agq:
        warnings.warn(f"n_agq={n_agq} has too many points for {len(spec.random)} random parameters; {f'order {used} was used' if used > 1 else 'the fit is Laplace'}", stacklevel=3)
    # Each group is in one partition, in the order that tasks need.
    rows = point_rows(df, spec).repartition("g").sortWithinPartitions("g", "x").persist()
    try:
        many, n, within = rows.agg(F.count("*"), F.sum("n"), F.sum("v")).first()
        if many > MOST_LOCAL and used == 1 and not refine:
            by_x = rows.groupBy("x").agg(F.avg("m").alias("m"), F.count("*").alias("n")).limit(MOST_POINTS + 1).toArrow().sort_by("x")
            if by_x.num_rows > MOST_POINTS:
                raise ModelError(f"more than {MOST_POINTS} distinct x")
            problem = spread.Spread(rows, curve, random, int(n), float(within), reml, lo, hi, own_lo, own_hi)
            theta, beta, sigma2, dev, count, ok = spread.fit(problem, _starts(curve, names, start, *[by_x[c].to_numpy() for c in ("x", "m", "n")]))
            labels, b = problem.effects(nlmm.triangle(theta, len(random)), beta)
            return NonlinearModel(spec.text, spec, curve, beta, theta, b, labels, sigma2, dev, int(n), reml, ok, count, df)
        data = points(df, spec, rows)
    finally:
        rows.unpersist()
    problem = nlmm.Problem(data, curve, random, reml, lo, hi, own_lo, own_hi)
    found = nlmm.fit(problem, _starts(curve, names, start, data.x, data.y), n_agq)
    theta, beta, b, sigma2, dev, n, ok = nlmm.refine(problem, found, n_agq) if refine else found
    return NonlinearModel(spec.text, spec, curve, beta, theta, b, data.labels, sigma2, dev, data.n, reml, ok, n, df)


def _starts(curve: Curve, names: list, start: dict | None, x, y, weights=None) -> list:
    """Where fits begin; ``weights``: the points behind each (x, y)."""
    if start:
        if set(start) - set(names):
            raise ModelError(f"start values for {sorted(set(start) - set(names))}; the parameters are {names}")
        base = curve.self_start(x, y)
        return [[float(start.get(n, base[k])) for k, n in enumerate(names)]]
    # The pooled curve by ordinary least squares from its own start, and that start.
    own = curve.self_start(x, y)
    try:
        pooled = nlmm.nls(curve, x, y, own, weights=weights)["parameters"]
    except (ValueError, np.linalg.LinAlgError):
        pooled = own
    return [pooled, own] if np.all(np.isfinite(pooled)) else [own]


def nlmer(formula: str, df: DataFrame, start: dict | None = None, reml: bool = False, n_agq: int = 1, lower=None, upper=None, group_lower=None, group_upper=None, refine: bool = False) -> NonlinearModel:
    """``refine``: fixed effects at the least deviance together with theta, not those of penalised least squares."""
    spec = parse_nlmer(formula)
    named = Curve(spec.curve, tuple(spec.parameters), CURVES[spec.curve].mean, CURVES[spec.curve].start)
    return _fit(df, spec, named, start, reml, n_agq, lower, upper, group_lower, group_upper, refine)


nlmer_with_options = nlmer


def nlmer_with_mean(formula: str, df: DataFrame, mean_fn, param_names: list[str], start: dict | None = None, reml: bool = False, n_agq: int = 1, lower=None, upper=None, group_lower=None, group_upper=None, refine: bool = False) -> NonlinearModel:
    """``mean_fn(x, params) -> (value, gradient)`` on plain numbers; probed once before the fit."""
    spec = parse_nlmer(formula, list(param_names))
    return _fit(df, spec, custom_curve("custom", param_names, mean_fn), start, reml, n_agq, lower, upper, group_lower, group_upper, refine)


def nls_by_key(df: DataFrame, key: str, x: str, y: str, curve: str) -> DataFrame:
    """An independent least-squares curve for every key, in tasks, from a key's distinct x with number, mean and squares within.

    (key, parameters, rss, n, converged) are those of the rows themselves; rows of null x or y are left out.
    """
    if curve not in CURVES:
        raise ModelError(f"unknown curve {curve}; one of {sorted(CURVES)}")
    ship(df.sparkSession)
    value = F.col(f"`{y}`").cast("double")
    named = df.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{x}`").cast("double").alias("x"), value.alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    rows = named.groupBy("key", "x").agg(F.avg("y").alias("y"), F.count("*").alias("n"), (F.var_pop("y") * F.count("*")).alias("within"))
    name = curve

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        curve = CURVES[name]
        try:
            fit = nlmm.nls(curve, pdf["x"].to_numpy(), pdf["y"].to_numpy(), weights=pdf["n"].to_numpy(float), within=float(pdf["within"].sum()))
        except (ValueError, np.linalg.LinAlgError, IndexError):
            fit = {"parameters": [math.nan] * len(curve.parameters), "rss": math.nan, "converged": False}
        return pd.DataFrame([(pdf["key"].iloc[0], fit["parameters"], fit["rss"], int(pdf["n"].sum()), fit["converged"])], columns=["key", "parameters", "rss", "n", "converged"])

    return rows.groupBy("key").applyInPandas(run, "key string, parameters array<double>, rss double, n long, converged boolean")
