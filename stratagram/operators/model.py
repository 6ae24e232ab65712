"""Fitted models: small numbers on the driver, everything by row as expressions."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import special
from ..functions.families import COLUMNS, Family, Link
from ..plans.design import Design, ModelError, group_key
from .gram import Gram, _effect, factor_column

#: Random effects up to this many rows are broadcast when rows are scored; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


@dataclass
class ConfidenceIntervals:
    names: list
    lower: list
    upper: list
    level: float
    method: str = "wald"

    def as_tuples(self) -> list[tuple]:
        return list(zip(self.lower, self.upper))

    def __len__(self) -> int:
        return len(self.names)

    def __getitem__(self, i):
        return self.lower[i], self.upper[i]

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(zip(self.names, map(float, self.lower), map(float, self.upper))), "name string, lower double, upper double")


@dataclass
class FittedModel:
    """lm, lmer, glmer: estimates, and what post-fit queries need of the data."""

    design: Design
    kind: str
    coefficients: np.ndarray
    v_unscaled: np.ndarray
    sigma2: float | None
    theta: np.ndarray
    deviance: float
    reml: bool
    num_obs: int
    labels: list  # by factor
    b: list  # by factor: (m, k)
    u: list
    covariance: list  # by factor: (k, k)
    factors: list
    layout: list
    n_params: int
    converged: bool = True
    iterations: int = 0
    gram: Gram | None = None
    family: Family | None = None
    link: Link | None = None
    phi: float | None = None
    data: DataFrame | None = None
    weights: str | None = None
    log_likelihood: float = math.nan
    extra: dict = field(default_factory=dict)

    # ------------------------------------------------------------- estimates

    @property
    def formula(self) -> str:
        return self.design.formula

    @property
    def fixed_names(self) -> list[str]:
        return self.design.names

    @property
    def fixed_term_assign(self) -> list[str]:
        return self.design.terms

    @property
    def categorical_levels(self) -> dict:
        return self.design.levels

    @property
    def family_name(self):
        return self.family.name if self.family else None

    @property
    def link_name(self):
        return self.link.name if self.link else None

    @property
    def v_beta_unscaled(self) -> np.ndarray:
        return self.v_unscaled

    @property
    def vcov(self) -> np.ndarray:
        return self.v_unscaled * (self.sigma2 if self.kind in ("lm", "lmer") else 1.0)

    @property
    def beta_se(self) -> np.ndarray:
        return np.sqrt(np.diag(self.vcov))

    std_errors = beta_se

    @property
    def beta_t(self) -> np.ndarray:
        return self.coefficients / self.beta_se

    @property
    def reml_criterion(self):
        return self.deviance if self.reml else None

    @property
    def aic(self) -> float:
        return -2 * self.log_likelihood + 2 * self.n_params

    @property
    def bic(self) -> float:
        return -2 * self.log_likelihood + self.n_params * math.log(self.num_obs)

    @property
    def is_singular(self) -> bool:
        at, out = 0, False
        for _, _, k, _ in self.layout:
            for j in range(k):
                out |= abs(self.theta[at]) < 1e-5
                at += k - j
        return bool(out)

    @property
    def theta_names(self) -> list[str]:
        """group.effect of each entry of theta (group.effect.effect off the diagonal)."""
        out = []
        for f, _, k, names in self.layout:
            g = ":".join(self.factors[f].group)
            out += [f"{g}.{names[j]}" if i == j else f"{g}.{names[j]}.{names[i]}" for j in range(k) for i in range(j, k)]
        return out

    def ranef(self, spark: SparkSession) -> DataFrame:
        """(grouping, group, effect, value)."""
        parts = [pa.table({"grouping": pa.repeat(":".join(f.group), len(labels)), "group": pa.array(labels, pa.string()), "effect": pa.repeat(e, len(labels)), "value": b[:, j]}) for f, labels, b in zip(self.factors, self.labels, self.b) for j, e in enumerate(f.effects)]
        return spark.createDataFrame(pa.concat_tables(parts)) if parts else spark.createDataFrame([], "grouping string, group string, effect string, value double")

    def var_corr_rows(self) -> list[tuple]:
        rows = []
        for f, first, k, names in self.layout:
            cov, g = self.covariance[f][first : first + k, first : first + k], ":".join(self.factors[f].group)
            for j in range(k):
                for i in range(j, k):
                    sd = math.sqrt(cov[i, i] * cov[j, j])
                    rows.append((g, names[j], names[i], float(cov[i, j]), math.sqrt(cov[i, i]) if i == j else None, None if i == j else float(cov[i, j] / sd) if sd > 0 else None))
        if self.sigma2 is not None and self.kind != "glmer" or self.phi is not None and self.family is not None and self.family.dispersion:
            s2 = self.sigma2
            rows.append(("Residual", "", "", float(s2), math.sqrt(s2), None))
        return rows

    def var_corr(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.var_corr_rows(), "grouping string, effect1 string, effect2 string, variance double, std_dev double, corr double")

    # --------------------------------------------------------------- scoring

    def linear_predictor(self, include_offset: bool = True) -> Column:
        """X beta as one expression; stateless, so it works on streams."""
        out = F.lit(0.0)
        for c, beta in zip(self.design.columns, self.coefficients):
            out = out + c.column() * F.lit(float(beta))
        return out + self.design.offset_column() if include_offset and self.design.offset else out

    def predict(self, newdata: DataFrame, name: str = "prediction", include_offset: bool = True) -> DataFrame:
        """Population prediction on the link scale."""
        return newdata.withColumn(name, self.linear_predictor(include_offset))

    def _response(self, eta: Column) -> Column:
        return self.link.inverse(eta, COLUMNS) if self.link else eta

    def predict_response(self, newdata: DataFrame, name: str = "prediction", include_offset: bool = True) -> DataFrame:
        return newdata.withColumn(name, self._response(self.linear_predictor(include_offset)))

    def _with_effects(self, df: DataFrame, allow_new_levels: bool) -> tuple[DataFrame, Column]:
        spark, eta, added = df.sparkSession, F.lit(0.0), []
        for i, f in enumerate(self.factors):
            names = [f"__b{i}_{j}" for j in range(len(f.effects))]
            table = spark.createDataFrame(pa.table({f"__g{i}": pa.array(self.labels[i], pa.string())} | {n: self.b[i][:, j] for j, n in enumerate(names)}))
            table = F.broadcast(table) if len(self.labels[i]) <= BROADCAST_ROWS else table
            key = group_key(f.group)
            df = df.withColumn(f"__k{i}", key).join(table, F.col(f"__k{i}") == F.col(f"__g{i}"), "left")
            for n, e in zip(names, f.effects):
                b = F.coalesce(F.col(n), F.lit(0.0) if allow_new_levels else F.raise_error(F.concat(F.lit(f"a level of {':'.join(f.group)} that the model doesn't know: "), F.col(f"__k{i}"))).cast("double"))
                eta = eta + b * factor_column(_effect(e))
            added += [f"__k{i}", f"__g{i}", *names]
        return df, (eta, added)

    def _conditional(self, newdata, name, allow_new_levels, include_offset, response):
        df, (zb, added) = self._with_effects(newdata, allow_new_levels)
        eta = self.linear_predictor(include_offset) + zb
        return df.withColumn(name, self._response(eta) if response else eta).drop(*added)

    def predict_conditional(self, newdata: DataFrame, allow_new_levels: bool = False, name: str = "prediction", include_offset: bool = True) -> DataFrame:
        """With the random effects: a left join by group, broadcast while the effects are few."""
        return self._conditional(newdata, name, allow_new_levels, include_offset, False)

    def predict_conditional_response(self, newdata: DataFrame, allow_new_levels: bool = False, name: str = "prediction", include_offset: bool = True) -> DataFrame:
        return self._conditional(newdata, name, allow_new_levels, include_offset, True)

    def fitted(self, data: DataFrame | None = None) -> DataFrame:
        """``data`` (by default the training table) with fitted and residual."""
        df = self.predict_conditional_response(self._data(data), name="fitted")
        return df.withColumn("residual", F.col(f"`{self.design.response}`").cast("double") - F.col("fitted"))

    def _data(self, data: DataFrame | None) -> DataFrame:
        if data is None and self.data is None:
            raise ModelError("a loaded model has no data; give the table")
        return self.data if data is None else data

    # --------------------------------------------------------- post-fit calls

    def confint(self, level: float = 0.95, method: str = "wald", parms=None, which: str = "fixed") -> ConfidenceIntervals:
        from . import inference, profile_ci

        if method == "wald":
            return inference.wald(self, level, parms)
        if method != "profile":
            raise ModelError(f"unknown method {method!r}: wald or profile")
        return profile_ci.profile_intervals(self, level, parms, which)

    def with_satterthwaite(self):
        from . import inference

        self.extra["satterthwaite"] = inference.satterthwaite(self)
        return self

    def with_kenward_roger(self):
        from . import inference

        self.extra["kenward_roger"] = inference.kenward_roger(self)
        return self

    def with_robust_se(self, data: DataFrame | None = None, cluster_col: str | None = None):
        from . import inference

        self.extra["robust"] = inference.robust(self, self._data(data), cluster_col)
        return self

    def __getattr__(self, name):
        stored = self.__dict__.get("extra", {})
        for key, fields in (("satterthwaite", {"satterthwaite_dfs": "dfs", "satterthwaite_p_values": "p_values"}), ("kenward_roger", {"kenward_roger_dfs": "dfs", "kenward_roger_p_values": "p_values"}), ("robust", {"robust_se": "se", "robust_t": "t", "robust_p_values": "p_values", "v_beta_robust": "vcov"})):
            if name in fields:
                return stored[key][fields[name]] if key in stored else None
        raise AttributeError(name)

    def anova(self, ddf_method: str = "satterthwaite", anova_type: str = "III"):
        from . import inference

        return inference.anova_terms(self, ddf_method, anova_type)

    def linear_hypothesis(self, term: str, ddf_method: str = "satterthwaite"):
        return self.linear_hypothesis_terms([term], ddf_method)

    def linear_hypothesis_terms(self, terms: list[str], ddf_method: str = "satterthwaite"):
        from . import inference

        rows = [k for k, t in enumerate(self.design.terms) if t in terms]
        unknown = set(terms) - set(self.design.terms)
        if unknown or not rows:
            raise ModelError(f"no terms {sorted(unknown or terms)}; the model has {sorted(set(self.design.terms))}")
        return inference.test_contrast(self, np.eye(len(self.coefficients))[rows], None, ddf_method)

    def test_contrast(self, l_matrix, ddf_method: str = "satterthwaite"):
        from . import inference

        return inference.test_contrast(self, l_matrix, None, ddf_method)

    def test_contrast_vs(self, l_matrix, beta_h, ddf_method: str = "satterthwaite"):
        from . import inference

        return inference.test_contrast(self, l_matrix, beta_h, ddf_method)

    def glht(self, term, mcp="tukey", adjust="tukey", ddf_method=None, control=None):
        from . import comparisons

        return comparisons.glht(self, term, mcp, adjust, ddf_method, control)

    def emmeans(self, term, data: DataFrame | None = None, level=0.95, ddf_method=None):
        from . import comparisons

        return comparisons.emmeans(self, term, self._data(data), level, ddf_method)

    def emmeans_pairs(self, term, data: DataFrame | None = None, adjust="tukey", ddf_method=None):
        from . import comparisons

        return comparisons.emmeans_pairs(self, term, self._data(data), adjust, ddf_method)

    def simulate(self, nsim: int, seed: int = 0, data: DataFrame | None = None) -> DataFrame:
        from . import resample

        return resample.simulate(self, self._data(data), nsim, seed)

    def simulate_batches(self, nsim: int, batch_size: int, seed: int = 0, data: DataFrame | None = None):
        """Tables of at most ``batch_size`` draws each, drawn when asked for."""
        from . import resample

        for at in range(0, nsim, batch_size):
            yield resample.simulate(self, self._data(data), min(batch_size, nsim - at), seed, first=at)

    def boot(self, nsim: int = 200, method: str = "parametric", seed: int = 0, data: DataFrame | None = None):
        from . import resample

        return resample.boot(self, self._data(data), nsim, method, seed)

    boot_glmer = boot

    # ----------------------------------------------------------------- output

    def summary(self) -> str:
        what = {"lm": "Linear model", "lmer": f"Linear mixed model fit by {'REML' if self.reml else 'maximum likelihood'}", "glmer": f"Generalized linear mixed model ({self.family_name}, {self.link_name})"}[self.kind]
        lines = [what, f"Formula: {self.formula}", f"{'AIC':>12}{'BIC':>12}{'logLik':>12}{'deviance':>12}", "".join(f"{v:12.3f}" for v in (self.aic, self.bic, self.log_likelihood, self.deviance))]
        if self.factors:
            lines += ["Random effects:"] + [f"  {g:<16}{a:<16}{b if b != a else '':<16}{v:14.6g}{'' if s is None else f'{s:14.6g}'}" for g, a, b, v, s, _ in self.var_corr_rows()]
            lines += [f"Number of obs: {self.num_obs}, groups: " + ", ".join(f"{':'.join(f.group)} {len(v)}" for f, v in zip(self.factors, self.labels))]
        else:
            lines += [f"Number of obs: {self.num_obs}"]
        df = self.extra.get("kenward_roger") or self.extra.get("satterthwaite")
        lines += ["Fixed effects:", f"  {'':<24}{'Estimate':>12}{'Std. Error':>12}{'value':>10}" + (f"{'df':>10}{'p':>12}" if df else "")]
        for k, n in enumerate(self.fixed_names):
            lines.append(f"  {n:<24}{self.coefficients[k]:12.5f}{self.beta_se[k]:12.5f}{self.beta_t[k]:10.3f}" + (f"{df['dfs'][k]:10.2f}{df['p_values'][k]:12.4g}" if df else ""))
        if self.is_singular:
            lines.append("The fit is singular.")
        return "\n".join(lines)

    __str__ = summary

    def residual_summary(self, data: DataFrame | None = None) -> list[float]:
        """Order statistics at 0, n/4, n/2, 3n/4 and n-1 of the residuals."""
        return order_statistics(self.fitted(data).select(F.col("residual").cast("double").alias("v")), lambda n: (0, n // 4, n // 2, 3 * n // 4, n - 1))

    def coefficient_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, float(b), float(s), float(b / s)) for n, b, s in zip(self.fixed_names, self.coefficients, self.beta_se)], "name string, estimate double, std_error double, statistic double")

    def to_json(self) -> str:
        keep = {"kind": self.kind, "sigma2": self.sigma2, "deviance": self.deviance, "reml": self.reml, "num_obs": self.num_obs, "n_params": self.n_params, "converged": self.converged, "iterations": self.iterations, "phi": self.phi, "weights": self.weights, "log_likelihood": self.log_likelihood}
        arrays = {"coefficients": self.coefficients, "v_unscaled": self.v_unscaled, "theta": self.theta}
        return json.dumps(keep | {k: v.tolist() for k, v in arrays.items()} | {"design": self.design.to_dict(), "labels": self.labels, "b": [x.tolist() for x in self.b], "u": [x.tolist() for x in self.u], "covariance": [x.tolist() for x in self.covariance], "family": self.family_name, "link": self.link_name})

    @classmethod
    def from_json(cls, text: str) -> "FittedModel":
        from ..functions import families
        from .gram import factors_of

        d = json.loads(text)
        design = Design.from_dict(d.pop("design"))
        factors, layout = factors_of(design)
        fam = families.family(d.pop("family")) if d["family"] else d.pop("family")
        lk = families.link(fam, d.pop("link")) if fam else d.pop("link")
        arrays = {k: np.array(d.pop(k), float) for k in ("coefficients", "v_unscaled", "theta")}
        lists = {k: [np.array(x, float) for x in d.pop(k)] for k in ("b", "u", "covariance")}
        return cls(design=design, factors=factors, layout=layout, family=fam, link=lk, **arrays, **lists, **d)


#: Parts of a range whose rows are counted in one pass, and distinct values that the driver sorts.
PARTS, FEW = 4096, 20_000


def order_statistics(rows: DataFrame, ranks) -> list[float]:
    """The values of ``rows`` (v; nulls don't count) at ``ranks`` (a function of their number; from 0), exactly, without a sort.

    Each pass counts the rows in equal parts of the ranges that hold a rank, with each part's least and largest value,
    until a part has one value or few.  Infinities and NaN (last) come by their counts.
    """
    v, inf = F.col("v"), float("inf")
    finite = F.when(~F.isnan(v) & (F.abs(v) < inf), v)
    n, low, high, below, inside = rows.agg(F.count("v"), F.min(finite), F.max(finite), F.count_if(v == -inf), F.count(finite)).first()
    above = rows.where(v == inf).count() if n > below + inside else 0
    if not n:
        return [math.nan for _ in ranks(0)]
    found, open_ = {}, {}
    for k in set(ranks(n)):
        if below <= k < below + inside:
            open_.setdefault((low, high, below), set()).add(k)
        else:
            found[k] = -inf if k < below else inf if k < below + inside + above else math.nan
    while open_:
        again: dict = {}
        for (a, b, before), wanted in open_.items():
            if a == b:
                found |= dict.fromkeys(wanted, a)
        spans = [s for s in open_ if s[0] < s[1]]
        if not spans:
            break
        # Halves, since the whole range may be more than a double holds.
        part = F.lit(None).cast("int")
        for i, (a, b, _) in enumerate(spans):
            share = (v / 2.0 - a / 2.0) / max(b / 2.0 - a / 2.0, 5e-324)
            part = F.when((v >= a) & (v <= b), i * PARTS + F.least(F.floor(share * PARTS), F.lit(PARTS - 1)).cast("int")).otherwise(part)
        counts = rows.select("v", part.alias("part")).where("part IS NOT NULL").groupBy("part").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        counts = sorted((r["part"], r["n"], r["a"], r["b"]) for r in counts)
        small = []
        for i, span in enumerate(spans):
            at = span[2]
            for _, m, a, b in (c for c in counts if c[0] // PARTS == i):
                inner = {k for k in open_[span] if at <= k < at + m}
                if inner and (a == b or m > FEW):
                    again.setdefault((a, b, at), set()).update(inner)
                elif inner:
                    small.append((a, b, at, inner))
                at += m
        if small:
            held = F.lit(False)
            for a, b, *_ in small:
                held = held | v.between(a, b)
            values = np.sort(np.array([r["v"] for r in rows.where(held).collect()], float))
            for a, _, at, inner in small:
                first = int(np.searchsorted(values, a))
                found |= {k: float(values[first + k - at]) for k in inner}
        open_ = again
    return [float(found[k]) for k in ranks(n)]


def normal_p(z: float) -> float:
    return special.norm_two_sided(z)
