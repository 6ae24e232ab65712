"""Simulation, bootstrap and grouped cross-validation.

Draws depend on the seed and on how the table is partitioned; they aren't
those of another implementation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.families import COLUMNS, NUMPY
from ..plans.design import ModelError, analyze, group_key
from . import generalized, linear
from .gram import Gram, _matrix, _pairs, _sums, build_gram, design_rows, factors_of
from .kernels import glmm, lmm
from .model import FittedModel

#: Rows that a residual bootstrap takes: all residuals go to every task. A longer table is refused.
MOST_RESIDUALS = 20_000_000


def draw(rng, family: str, mu, sigma2, w):
    """One response per mean; binomial responses are shares of the weights' trials where those are whole."""
    if family == "binomial":
        n = np.maximum(1, np.rint(w)).astype(int)
        return rng.binomial(n, np.clip(mu, 0, 1)) / n
    if family == "poisson":
        return rng.poisson(np.minimum(mu, 1e15)).astype(float)
    if family == "gamma":
        return rng.gamma(1 / max(sigma2, 1e-12), np.maximum(mu, 1e-300) * sigma2)
    return mu + rng.normal(0, math.sqrt(sigma2), len(mu)) / np.sqrt(w)


def simulate(model: FittedModel, data: DataFrame, nsim: int, seed: int = 0, first: int = 0) -> DataFrame:
    """(row, sim, value): draws around the conditional means of ``data``'s rows."""
    w = F.lit(1.0) if model.weights is None else F.col(f"`{model.weights}`").cast("double")
    rows = model.predict_conditional_response(data, name="__mu").select(F.monotonically_increasing_id().alias("row"), F.col("__mu").cast("double").alias("mu"), w.alias("w"))
    family, sigma2 = model.family_name or "gaussian", model.sigma2 if model.sigma2 is not None else 1.0

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rngs = [np.random.default_rng([seed, first + i, part]) for i in range(nsim)]
        for b in batches:
            row, mu, wt = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for i, rng in enumerate(rngs):
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.full(len(row), first + i, np.int32)), pa.array(draw(rng, family, mu, sigma2, wt))], names=["row", "sim", "value"])

    return rows.mapInArrow(run, "row long, sim int, value double")


# ------------------------------------------------------------------ bootstrap


@dataclass
class BootConfint:
    names: list
    estimate: list
    lower: list
    upper: list
    level: float

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, *map(float, r)) for n, *r in zip(self.names, self.estimate, self.lower, self.upper)], "name string, estimate double, lower double, upper double")


@dataclass
class BootResult:
    """Replicates as a table: (index, coefficients, theta, sigma2, converged)."""

    method: str
    nsim: int
    fixed_names: list
    theta_names: list
    t0: list
    t0_theta: list
    t0_sigma2: float | None
    replicates: DataFrame

    @property
    def prop_converged(self) -> float:
        return float(self.replicates.agg(F.avg(F.col("converged").cast("double"))).first()[0])

    def confint(self, level: float = 0.95, which: str = "fixed") -> BootConfint:
        """Type-7 percentiles of the converged replicates."""
        if which not in ("fixed", "vc", "variance", "all"):
            raise ModelError(f"unknown scope {which!r}: fixed, vc or all")
        parts = []
        if which in ("fixed", "all"):
            parts += [(n, F.col("coefficients")[k], self.t0[k]) for k, n in enumerate(self.fixed_names)]
        if which != "fixed":
            parts += [(n, F.col("theta")[k], self.t0_theta[k]) for k, n in enumerate(self.theta_names)]
            parts += [("sigma2", F.col("sigma2"), self.t0_sigma2)] if self.t0_sigma2 is not None else []
        a = (1 - level) / 2
        got = self.replicates.where("converged").agg(*[F.percentile(c, F.array(F.lit(a), F.lit(1 - a))).alias(f"q{k}") for k, (_, c, _) in enumerate(parts)]).first()
        qs = [got[f"q{k}"] or [math.nan, math.nan] for k in range(len(parts))]
        return BootConfint([n for n, *_ in parts], [e for *_, e in parts], [q[0] for q in qs], [q[1] for q in qs], level)


_REPLICATE = "index int, coefficients array<double>, theta array<double>, sigma2 double, converged boolean"


def _result(model: FittedModel, method: str, nsim: int, replicates: DataFrame) -> BootResult:
    return BootResult(method, nsim, model.fixed_names, model.theta_names, model.coefficients.tolist(), model.theta.tolist(), model.sigma2, replicates.persist())


def boot(model: FittedModel, data: DataFrame, nsim: int = 200, method: str = "parametric", seed: int = 0) -> BootResult:
    if method not in ("parametric", "residual"):
        raise ModelError(f"unknown method {method!r}: parametric or residual")
    if model.kind == "glmer":
        if method == "residual":
            raise ModelError("a residual bootstrap is for linear models")
        return _boot_glmm(model, nsim, seed, data.sparkSession)
    if model.kind != "lmer":
        raise ModelError("the bootstrap is for mixed models")
    return _boot_lmm(model, data, nsim, method, seed)


def _boot_lmm(model: FittedModel, data: DataFrame, nsim: int, method: str, seed: int) -> BootResult:
    """One pass draws all responses and adds up their products; then a fit per replicate, in tasks."""
    design, spark = model.design, data.sparkSession
    factors, _ = factors_of(design)
    scored = model.fitted(data)
    pool = None
    if method == "residual":
        n = model.num_obs
        if n > MOST_RESIDUALS:
            raise ModelError(f"a residual bootstrap draws from all residuals and takes {MOST_RESIDUALS} rows at most; the table has {n}")
        pool = spark.sparkContext.broadcast(scored.select("residual").toPandas()["residual"].to_numpy())
    fitted = F.col("fitted") - design.offset_column() - F.lit(design.shift) if design.offset else F.col("fitted") - F.lit(design.shift)
    rows, e = design_rows(scored, design, factors, model.weights, keep=(fitted.alias("fit"),))
    width = max([len(e.x) + 1, *map(len, e.z)])
    sigma, x, zs, nf, nu = math.sqrt(model.sigma2), e.x, e.z, len(factors), len(e.columns)

    def products(batches):
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for b in batches:
            if not b.num_rows:
                continue
            at = {n: i for i, n in enumerate(b.schema.names)}
            u = {i: b.column(at[f"u{i}"]).to_numpy(zero_copy_only=False) for i in range(nu)}
            w, fit = b.column(at["w"]).to_numpy(zero_copy_only=False), b.column(at["fit"]).to_numpy(zero_copy_only=False)
            noise = rng.normal(0, sigma, (nsim, len(w))) / np.sqrt(w) if pool is None else rng.choice(pool.value, (nsim, len(w)))
            y = fit + noise
            yw = y * w
            out = []
            total = np.zeros((nsim, width))
            total[:, : len(x)] = yw @ np.stack([u[i] for i in x], axis=1) if x else 0.0
            total[:, len(x)] = (yw * y).sum(axis=1)
            out.append((np.arange(nsim), np.full(nsim, -1), [""] * nsim, total))
            for f in range(nf):
                labels, code = np.unique(np.asarray(b.column(at[f"g{f}"]).to_pylist(), dtype=object), return_inverse=True)
                order = np.argsort(code, kind="stable")
                begin = np.searchsorted(code[order], np.arange(len(labels)))
                sums = np.zeros((nsim, len(labels), width))
                for j, i in enumerate(zs[f]):
                    sums[:, :, j] = np.add.reduceat((yw * u[i])[:, order], begin, axis=1)
                out.append((np.repeat(np.arange(nsim), len(labels)), np.full(nsim * len(labels), f), list(labels) * nsim, sums.reshape(-1, width)))
            for rep, factor, label, v in out:
                yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int32()), pa.array(factor, pa.int32()), pa.array(label, pa.string()), *[pa.array(v[:, j].copy()) for j in range(width)]], names=["rep", "factor", "label", *[f"v{j}" for j in range(width)]])

    schema = "rep int, factor int, label string, " + ", ".join(f"v{j} double" for j in range(width))
    sums = rows.mapInArrow(products, schema).groupBy("rep", "factor", "label").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(width)])
    shared, reml, theta = spark.sparkContext.broadcast(model.gram), model.reml, model.theta

    def fit_one(pdf: pd.DataFrame) -> pd.DataFrame:
        g: Gram = shared.value
        v = pdf[[f"v{j}" for j in range(width)]].to_numpy(float)
        total = v[(pdf["factor"] == -1).to_numpy()][0, : g.p + 1]
        c = []
        for k, f in enumerate(g.factors):
            mine = (pdf["factor"] == k).to_numpy()
            at = {s: i for i, s in enumerate(f.labels)}
            y = np.zeros((len(f.labels), len(f.effects)))
            y[[at[s] for s in pdf["label"][mine]]] = v[mine][:, : len(f.effects)]
            c.append(y)
        index = int(pdf["rep"].iloc[0])
        try:
            fit, _, ok = lmm.fit(g.with_response(total, c), reml, theta)
            beta = fit.beta.copy()
            if design.shift:
                beta[design.names.index("(Intercept)")] += design.shift
            return pd.DataFrame([(index, beta.tolist(), fit.theta.tolist(), fit.sigma2, ok)], columns=["index", "coefficients", "theta", "sigma2", "converged"])
        except (ValueError, np.linalg.LinAlgError):
            return pd.DataFrame([(index, [math.nan] * g.p, [math.nan] * len(theta), math.nan, False)], columns=["index", "coefficients", "theta", "sigma2", "converged"])

    return _result(model, method, nsim, sums.groupBy("rep").applyInPandas(fit_one, _REPLICATE))


def _boot_glmm(model: FittedModel, nsim: int, seed: int, spark: SparkSession) -> BootResult:
    """Replicates on the compressed rows; equal rows' sums are sufficient for binomial and Poisson."""
    if model.family.name == "gaussian":
        raise ModelError("no bootstrap of a gaussian generalized model")
    d: glmm.Patterns = model.extra["patterns"]
    if d.within:
        # Draws of a mean response say nothing of the rows about it.
        d = generalized.patterns(model.data, model.design, model.family, model.weights, pooled=False)
    eta = d.x @ model.coefficients + d.zb(model.b) + d.offset
    mu = model.link.inverse(eta, NUMPY)
    shared, fam, lk, sigma2 = spark.sparkContext.broadcast((d, mu)), model.family, model.link, model.sigma2 or 1.0
    names = (fam.name, lk.name)

    def run(it):
        from ..functions import families

        fam = families.family(names[0])
        lk = families.link(fam, names[1])
        d, mu = shared.value
        for pdf in it:
            out = []
            for i in pdf["id"]:
                rng = np.random.default_rng([seed, int(i)])
                if fam.name == "poisson":
                    y = rng.poisson(np.minimum(mu * d.w, 1e15)) / d.w
                elif fam.name == "gamma":
                    y = rng.gamma(d.w / sigma2, mu * sigma2 / d.w)
                else:
                    y = draw(rng, fam.name, mu, sigma2, d.w)
                again = glmm.Patterns(d.x, np.asarray(y, float), d.w, d.offset, d.groups, d.z, d.factors, d.layout, d.names, d.n)
                try:
                    s, theta, _, ok = glmm.fit(again, fam, lk, 1)
                    out.append((int(i), s.beta.tolist(), theta.tolist(), s.dev / float(d.w.sum()) if fam.dispersion else math.nan, ok))
                except (ValueError, np.linalg.LinAlgError):
                    out.append((int(i), [math.nan] * d.x.shape[1], [math.nan] * len(model_theta), math.nan, False))
            yield pd.DataFrame(out, columns=["index", "coefficients", "theta", "sigma2", "converged"])

    model_theta = model.theta.tolist()
    parts = min(nsim, spark.sparkContext.defaultParallelism * 2)
    return _result(model, "parametric", nsim, spark.range(0, nsim, 1, parts).mapInPandas(run, _REPLICATE))


boot_lmer = boot_glmer = boot


# ----------------------------------------------------------- cross-validation


@dataclass
class CvGrouped:
    """Fold metrics, and the table with each row's fold and out-of-fold prediction."""

    predictions: DataFrame
    rmse: float
    mae: float
    mean_log_loss: float | None
    folds: list
    all_converged: bool
    n_splits: int
    group_col: str

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.folds, "fold int, n_train_groups long, n_test_groups long, n_train_obs long, n_test_obs long, rmse double, mae double, mean_log_loss double, converged boolean")


def assign_folds(df: DataFrame, group: str, n_splits: int, seed: int = 0) -> DataFrame:
    """``df`` with fold: whole groups, as many to each fold as can be, by the rank of a seeded hash."""
    labels = df.select(group_key((group,)).alias("__label")).distinct().toPandas()["__label"].sort_values()
    if not 2 <= n_splits <= len(labels):
        raise ModelError(f"{n_splits} folds of {len(labels)} groups")
    order = np.random.default_rng(seed).permutation(len(labels))
    table = df.sparkSession.createDataFrame(pd.DataFrame({"__label": labels.to_numpy(), "fold": (np.argsort(order) * n_splits // len(labels)).astype(np.int32)}))
    joined = F.broadcast(table) if len(labels) <= 500_000 else table
    return df.withColumn("__key", group_key((group,))).join(joined, F.col("__key") == F.col("__label")).drop("__key", "__label")


def fold_grams(df: DataFrame, design, weights=None) -> dict[int, Gram]:
    """Sums by fold; one job if there is one grouping."""
    factors, layout = factors_of(design)
    if len(factors) == 1:
        rows, e = design_rows(df, design, factors, weights, keep=(F.col("fold"),))
        xy = e.x + [e.y]
        pdf = _sums(rows, ["g0", "fold"], _pairs(xy, xy) | _pairs(e.z[0], xy) | _pairs(e.z[0], e.z[0]), 4_000_000)
        out = {}
        for k, part in pdf.groupby("fold"):
            fs, _ = factors_of(design)
            f = fs[0]
            f.labels, f.n = part["g0"].tolist(), part["rows"].to_numpy(float)
            f.s, f.c = _matrix(part, e.z[0], e.z[0]), _matrix(part, e.z[0], xy)
            out[int(k)] = Gram(design.names, int(f.n.sum()), _matrix(part, xy, xy).sum(axis=0), fs, {}, layout)
        return out
    folds = [r[0] for r in df.select("fold").distinct().collect()]
    return {k: build_gram(df.where(F.col("fold") == k), design, weights) for k in folds}


def _combine(grams: list[Gram]) -> Gram:
    total = grams[0]
    for g in grams[1:]:
        total = total.combined(g, 1)
    return total


def _metrics(scored: DataFrame, binomial: bool):
    """rmse, mae, log loss by fold and over all rows, in one aggregate."""
    err = F.col("__y") - F.col("oof_prediction")
    p = F.least(F.greatest("oof_prediction", F.lit(1e-12)), F.lit(1 - 1e-12))
    loss = -(F.col("__y") * F.log(p) + (1.0 - F.col("__y")) * F.log(1.0 - p)) if binomial else F.lit(None).cast("double")
    return scored.rollup("fold").agg(F.count("*").alias("n"), F.countDistinct("__group").alias("groups"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"), F.avg(loss).alias("loss")).toPandas()


def _finish(df, design, models, group, n_splits, response, binomial) -> CvGrouped:
    pred = F.lit(None).cast("double")
    for k, m in models.items():
        eta = m.linear_predictor()
        pred = F.when(F.col("fold") == k, m.link.inverse(eta, COLUMNS) if response and m.link else eta).otherwise(pred)
    scored = df.withColumn("oof_prediction", pred)
    table = _metrics(scored.select("fold", F.col(f"`{design.response}`").cast("double").alias("__y"), "oof_prediction", group_key((group,)).alias("__group")), binomial)
    whole = table[table["fold"].isna()].iloc[0]
    folds = []
    for _, r in table[table["fold"].notna()].sort_values("fold").iterrows():
        loss = float(r["loss"]) if binomial else None
        folds.append((int(r["fold"]), int(whole["groups"] - r["groups"]), int(r["groups"]), int(whole["n"] - r["n"]), int(r["n"]), float(r["rmse"]), float(r["mae"]), loss, bool(models[int(r["fold"])].converged)))
    return CvGrouped(scored, float(whole["rmse"]), float(whole["mae"]), float(whole["loss"]) if binomial else None, folds, all(m.converged for m in models.values()), n_splits, group)


def cv_grouped(formula: str, df: DataFrame, group: str, n_splits: int = 5, reml: bool = True, seed: int = 0, weights: str | None = None, folds: DataFrame | None = None) -> CvGrouped:
    """Whole groups held out, population predictions.

    Training sums are all folds' sums but one, exactly, so the table is read
    once however many folds there are.  Encodings that depend on the data
    (orthogonal ``poly``, ``ns``) are learnt anew for each training set.
    """
    dealt = (folds if folds is not None else assign_folds(df, group, n_splits, seed)).persist()
    design = analyze(dealt, formula)
    depends = any(f[0] in ("poly", "ns") for c in design.columns for f in c.factors)
    models = {}
    if depends:
        for k in range(n_splits):
            models[k] = linear.prepare_lmer(formula, dealt.where(F.col("fold") != k), weights).fit(reml)
    else:
        grams = fold_grams(dealt, design, weights)
        for k in sorted(grams):
            train = _combine([g for j, g in grams.items() if j != k])
            fit, count, ok = lmm.fit(train, reml)
            models[k] = linear._assemble(design, train, fit, "lmer", count, ok, None, weights)
    return _finish(dealt, design, models, group, n_splits, False, False)


def cv_grouped_glmer(formula: str, df: DataFrame, group: str, family: str, n_splits: int = 5, n_agq: int = 1, weights: str | None = None, link: str | None = None, seed: int = 0, folds: DataFrame | None = None) -> CvGrouped:
    """Predictions on the scale of the response; log loss for binomial responses."""
    dealt = (folds if folds is not None else assign_folds(df, group, n_splits, seed)).persist()
    models = {k: generalized.prepare_glmer(formula, dealt.where(F.col("fold") != k), family, n_agq, weights, link).fit() for k in range(n_splits)}
    first = next(iter(models.values()))
    return _finish(dealt, first.design, models, group, n_splits, True, first.family.name == "binomial")
