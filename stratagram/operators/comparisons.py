"""Multiple comparisons and marginal means."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import special
from ..plans.design import ModelError
from . import inference
from .model import FittedModel

#: Rows of the grid of categorical levels.
MOST_GRID = 4096


@dataclass
class Comparisons:
    term: str
    kind: str
    adjust: str
    statistic: str
    comparisons: list
    estimate: list
    std_error: list
    statistic_values: list
    den_df: list
    p_value: list
    p_adjust: list

    @property
    def mcp(self) -> str:
        return self.kind

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = zip(self.comparisons, *[[float(v) for v in c] for c in (self.estimate, self.std_error, self.statistic_values, self.den_df, self.p_value, self.p_adjust)])
        return spark.createDataFrame(list(rows), "comparison string, estimate double, std_error double, statistic double, den_df double, p_value double, p_adjust double")


@dataclass
class Emmeans:
    term: str
    levels: list
    confidence_level: float
    statistic: str
    estimate: list
    std_error: list
    den_df: list
    lower: list
    upper: list
    linfct: list

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = zip(self.levels, *[[float(v) for v in c] for c in (self.estimate, self.std_error, self.den_df, self.lower, self.upper)])
        return spark.createDataFrame(list(rows), "level string, estimate double, std_error double, den_df double, lower double, upper double")


def adjust_p(p: list[float], method: str, t: list[float] | None = None, means: int = 0, df: list[float] | None = None) -> list[float]:
    m = len(p)
    if method == "none":
        return list(p)
    if method == "bonferroni":
        return [min(1.0, m * v) for v in p]
    if method == "holm":
        out, top = [0.0] * m, 0.0
        for rank, k in enumerate(sorted(range(m), key=lambda k: p[k])):
            top = max(top, min(1.0, (m - rank) * p[k]))
            out[k] = top
        return out
    if method == "tukey":
        return [special.tukey_sf(abs(v) * math.sqrt(2), means, d) for v, d in zip(t, df)]
    raise ModelError(f"unknown adjustment {method!r}: none, bonferroni, holm or tukey")


def _df_of(model: FittedModel, l: np.ndarray, ddf_method: str | None) -> float:  # noqa: E741
    if ddf_method is None or model.kind != "lmer":
        return math.inf
    if ddf_method.lower().replace("-", "_") not in ("satterthwaite", "kenward_roger"):
        raise ModelError(f"unknown method {ddf_method!r}")
    return inference._bounded_df(inference._variances(model).df(l), model.num_obs - len(model.coefficients))


def _vcov(model: FittedModel, ddf_method: str | None) -> np.ndarray:
    if "robust" in model.extra:
        return model.extra["robust"]["vcov"]
    if ddf_method and ddf_method.lower().replace("-", "_") == "kenward_roger":
        return inference._kr(model)[1]
    return model.vcov


def _compare(model, term, kind, adjust, ddf_method, labels, rows, means) -> Comparisons:
    v = _vcov(model, ddf_method)
    est = [float(l @ model.coefficients) for l in rows]
    se = [float(math.sqrt(l @ v @ l)) for l in rows]
    t = [e / s for e, s in zip(est, se)]
    df = [_df_of(model, l, ddf_method) for l in rows]
    p = [special.norm_two_sided(x) if math.isinf(d) else special.t_two_sided(x, d) for x, d in zip(t, df)]
    if adjust == "tukey" and kind != "tukey":
        raise ModelError("the Tukey adjustment is for all pairs")
    return Comparisons(term, kind, adjust, "z" if ddf_method is None or model.kind != "lmer" else "t", labels, est, se, t, df, p, adjust_p(p, adjust, t, means, df))


def _level_rows(model: FittedModel, term: str) -> tuple[list, list]:
    """Each level of a categorical main effect against the reference of its coding."""
    levels = model.design.levels.get(term)
    if levels is None:
        raise ModelError(f"{term} is no categorical column of the model")
    names, p = model.fixed_names, len(model.coefficients)
    rows = []
    for v in levels:
        row = np.zeros(p)
        if f"{term}{v}" in names:
            row[names.index(f"{term}{v}")] = 1.0
        rows.append(row)
    return levels, rows


def mcp_contrast_matrix(model: FittedModel, term: str, mcp: str = "tukey", control: str | None = None) -> tuple[list, np.ndarray]:
    """(labels 'b - a', rows) of all pairs or of all against a control."""
    levels, rows = _level_rows(model, term)
    if mcp == "tukey":
        pairs = [(j, i) for i in range(len(levels)) for j in range(i + 1, len(levels))]
    elif mcp == "dunnett":
        if control is not None and control not in levels:
            raise ModelError(f"no level {control!r}; {term} has {levels}")
        c = levels.index(control) if control is not None else 0
        pairs = [(j, c) for j in range(len(levels)) if j != c]
    else:
        raise ModelError(f"unknown comparisons {mcp!r}: tukey or dunnett")
    return [f"{levels[j]} - {levels[i]}" for j, i in pairs], np.array([rows[j] - rows[i] for j, i in pairs])


def glht(model: FittedModel, term: str, mcp: str = "tukey", adjust: str = "tukey", ddf_method: str | None = None, control: str | None = None) -> Comparisons:
    mcp, adjust = mcp.lower(), adjust.lower()
    labels, rows = mcp_contrast_matrix(model, term, mcp, control)
    return _compare(model, term, mcp, adjust, ddf_method, labels, rows, len(model.design.levels[term]))


def reference_grid(model: FittedModel, term: str, data: DataFrame) -> tuple[list, np.ndarray]:
    """(levels, rows): design rows averaged over all combinations of the other factors, numbers at their means."""
    if model.kind == "glmer" or model.design.offset:
        raise ModelError("marginal means are for linear models without offset")
    if term not in model.design.levels:
        raise ModelError(f"{term} is no categorical column of the model")
    levels = model.design.levels
    names = list(levels)
    if math.prod(len(levels[n]) for n in names) > MOST_GRID:
        raise ModelError(f"a grid of more than {MOST_GRID} combinations")
    number = sorted({f[1] for c in model.design.columns for f in c.factors if f[0] in ("name", "log", "sqrt", "exp", "power", "poly", "ns")} | {n for c in model.design.columns for f in c.factors if f[0] == "expr" for n in _names(f[1])})
    spark = data.sparkSession
    means = data.agg(*[F.avg(F.col(f"`{n}`").cast("double")).alias(n) for n in number]).first() if number else {}
    combos = list(itertools.product(*[levels[n] for n in names]))
    grid = spark.createDataFrame([(*c, *[float(means[n]) for n in number]) for c in combos], ", ".join([f"`{n}` string" for n in names] + [f"`{n}` double" for n in number]))
    got = grid.select(F.col(f"`{term}`").alias("level"), *[c.column().alias(f"c{k}") for k, c in enumerate(model.design.columns)]).groupBy("level").agg(*[F.avg(f"c{k}").alias(f"c{k}") for k in range(len(model.design.columns))]).collect()
    by = {r["level"]: np.array([r[f"c{k}"] for k in range(len(model.design.columns))], float) for r in got}
    return levels[term], np.array([by[v] for v in levels[term]])


def _names(tree) -> set:
    from ..plans.formula import names_in

    return names_in(tree)


def emmeans(model: FittedModel, term: str, data: DataFrame, level: float = 0.95, ddf_method: str | None = None) -> Emmeans:
    levels, rows = reference_grid(model, term, data)
    v = _vcov(model, ddf_method)
    est, se = rows @ model.coefficients, np.sqrt(np.einsum("ij,jk,ik->i", rows, v, rows))
    df = [_df_of(model, r, ddf_method) for r in rows]
    q = [special.norm_ppf(0.5 + level / 2) if math.isinf(d) else special.t_ppf(0.5 + level / 2, d) for d in df]
    return Emmeans(term, levels, level, "z" if ddf_method is None else "t", est.tolist(), se.tolist(), df, (est - q * se).tolist(), (est + q * se).tolist(), rows.tolist())


def emmeans_pairs(model: FittedModel, term: str, data: DataFrame, adjust: str = "tukey", ddf_method: str | None = None) -> Comparisons:
    levels, rows = reference_grid(model, term, data)
    pairs = [(i, j) for i in range(len(levels)) for j in range(i + 1, len(levels))]
    return _compare(model, term, "tukey", adjust.lower(), ddf_method, [f"{levels[i]} - {levels[j]}" for i, j in pairs], [rows[i] - rows[j] for i, j in pairs], len(levels))
