"""Profiles over groups that stay in Spark: one grouping factor of any number of groups.

Group sums are written once; every set of theta candidates costs one pass over
them, and only (p + 1)-square sums come back.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.design import ModelError, analyze
from . import linear
from .gram import MOST_GROUPS, Factor, Gram, _pairs, _product, design_rows, factors_of
from .kernels import lmm
from .model import FittedModel


def group_sums(df: DataFrame, formula: str, weights: str | None = None):
    design = analyze(df, formula)
    factors, layout = factors_of(design)
    if len(factors) != 1:
        raise ModelError("a distributed profile has one grouping factor")
    rows, e = design_rows(df, design, factors, weights)
    xy = e.x + [e.y]
    pairs = sorted(_pairs(xy, xy) | _pairs(e.z[0], xy) | _pairs(e.z[0], e.z[0]))
    sums = rows.groupBy("g0").agg(F.count("*").alias("rows"), *[_product(i, j) for i, j in pairs])
    return design, factors[0], layout, e, xy, sums.persist()


def _gram_of(columns, names, factor, layout, e, xy, labels) -> Gram:
    at = {n: i for i, n in enumerate(columns)}
    take = lambda left, right, data: np.stack([np.stack([data[at[f"p{min(i, j)}_{max(i, j)}"]] for j in right], axis=-1) for i in left], axis=-2)
    return lambda data: Gram(names, 0, take(xy, xy, data).sum(axis=0), [Factor(factor.group, factor.effects, factor.blocks, labels, take(e.z[0], e.z[0], data), take(e.z[0], xy, data))], {}, layout)


def profile_many(sums: DataFrame, thetas: np.ndarray, names, factor, layout, e, xy) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log determinants, reduced sums) of each theta, from one pass over the group sums."""
    columns, k = sums.columns, len(xy)

    def run(batches):
        logs, mats = np.zeros(len(thetas)), np.zeros((len(thetas), k, k))
        for b in batches:
            data = [c.to_numpy(zero_copy_only=False) if pa.types.is_floating(c.type) else None for c in b.columns]
            gram = _gram_of(columns, names, factor, layout, e_index, xy, [])(data)
            for i, t in enumerate(thetas):
                s = lmm.Solution(gram, t)
                logs[i] += s.logdet
                mats[i] += s.s
        n = k * k + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(thetas)), n), pa.int32()), pa.array(np.tile(np.arange(n), len(thetas)), pa.int32()), pa.array(np.concatenate([logs[:, None], mats.reshape(len(thetas), -1)], axis=1).ravel())], names=["t", "i", "v"])

    class e_index:  # the expressions' numbers alone travel to the tasks
        x, z, y = e.x, e.z, e.y

    got = sums.mapInArrow(run, "t int, i int, v double").groupBy("t", "i").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((len(thetas), k * k + 1))
    out[got["t"], got["i"]] = got["v"]
    return out[:, 0], out[:, 1:].reshape(len(thetas), k, k)


def lmer_distributed(formula: str, df: DataFrame, reml: bool = True, weights: str | None = None, rounds: int = 6, width: int = 9) -> FittedModel:
    design, factor, layout, e, xy, sums = group_sums(df, formula, weights)
    n = int(sums.agg(F.sum("rows")).first()[0])
    size = sum(k * (k + 1) // 2 for _, _, k, _ in layout)

    def deviances(thetas):
        logs, mats = profile_many(sums, np.asarray(thetas), design.names, factor, layout, e, xy)
        return np.array([lmm.profile_deviance(m, d, n, reml) for d, m in zip(logs, mats)])

    if size == 1:  # a log grid, narrowed around its best
        centre, span, best = 0.0, 5.0, (math.inf, 0.0)
        for _ in range(rounds + 4):
            grid = centre + np.linspace(-span, span, width)
            values = deviances(np.exp(grid)[:, None])
            k = int(np.argmin(values))
            best = min(best, (float(values[k]), float(np.exp(grid[k]))))
            centre, span = grid[k], span * 2.5 / (width - 1)
        zero = float(deviances(np.zeros((1, 1)))[0])
        theta = np.array([0.0 if zero <= best[0] + 1e-10 else best[1]])
    else:  # each step of the simplex is a job
        from .kernels.optimize import minimise_theta

        theta, *_ = minimise_theta(lambda t: float(deviances([t])[0]), layout)
    logs, mats = profile_many(sums, theta[None, :], design.names, factor, layout, e, xy)
    s, p = mats[0], len(xy) - 1
    v = np.linalg.inv(s[:p, :p])
    beta = v @ s[:p, p]
    rss = float(s[p, p] - beta @ s[:p, p])
    sigma2 = rss / (n - p if reml else n)
    factor.labels = []
    gram = Gram(design.names, n, s, [factor], {}, layout)
    lam = lmm.lambdas(theta, gram)[0]
    none = [np.zeros((0, len(factor.effects)))]
    fit = lmm.LmmFit.of(theta=theta, reml=reml, v_unscaled=v, beta=beta, rss=rss, sigma2=sigma2, deviance=lmm.profile_deviance(s, logs[0], n, reml), u=none, b=none, covariance=[lam @ lam.T * sigma2])
    model = linear._assemble(design, gram, fit, "lmer", 0, True, df, weights)
    model.gram = None
    model.extra["group_sums"] = (sums, factor, layout, e, xy, lam, beta)
    return model


def ranef_distributed(model: FittedModel) -> DataFrame:
    """(group, b0, b1, ...) of a distributed fit, as a table."""
    sums, factor, layout, e, xy, lam, beta = model.extra["group_sums"]
    columns, names, k, theta = sums.columns, model.design.names, len(factor.effects), model.theta

    class e_index:
        x, z, y = e.x, e.z, e.y

    def run(batches):
        for b in batches:
            data = [c.to_numpy(zero_copy_only=False) if pa.types.is_floating(c.type) else None for c in b.columns]
            s = lmm.Solution(_gram_of(columns, names, factor, layout, e_index, xy, [])(data), theta)
            v = s.effects(np.concatenate([-beta, [1.0]]))[0] @ lam.T
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v[:, j]) for j in range(k)]], names=["group", *[f"b{j}" for j in range(k)]])

    return sums.mapInArrow(run, "group string, " + ", ".join(f"b{j} double" for j in range(k)))


# ------------------------------------------------------- generalized models


def parabola(f, start: float, tol: float = 1e-5, most: int = 40) -> tuple[float, float]:
    """Least f over (0, inf) in few evaluations: brackets on the log scale, then parabolas through the best three."""
    seen: dict[float, float] = {}

    def g(u):
        if u not in seen:
            seen[u] = f(math.exp(u))
        return seen[u]

    u = math.log(start)
    grid, step = [u - 1.0, u, u + 1.0], 1.0
    for v in grid:
        g(v)
    while len(seen) < most:
        order = sorted(seen)
        k = min(range(len(order)), key=lambda i: seen[order[i]])
        if k in (0, len(order) - 1):
            if abs(order[k] - u) > 12:
                break
            step *= 1.6
            g(order[k] + (step if k else -step))
            continue
        a, b, c = order[k - 1 : k + 2]
        fa, fb, fc = seen[a], seen[b], seen[c]
        den = (b - a) * (fb - fc) - (b - c) * (fb - fa)
        new = b - 0.5 * ((b - a) ** 2 * (fb - fc) - (b - c) ** 2 * (fb - fa)) / den if den else (a + c) / 2
        if not a < new < c or min(abs(new - v) for v in (a, b, c)) < 1e-3 * (c - a):
            new = (a + b) / 2 if b - a > c - b else (b + c) / 2
        if c - a < tol * 100 or abs(new - b) < tol:
            break
        g(new)
    best = min(seen, key=seen.get)
    return math.exp(best), seen[best]


def glmer_distributed(formula: str, df: DataFrame, family: str, link: str | None = None, weights: str | None = None, tol: float = 1e-7) -> FittedModel:
    """Laplace fits of one grouping whose distinct rows stay in Spark.

    Every iteration is one pass over the stored distinct rows: linear
    predictor, weights and working responses are expressions beside a join
    with the effects so far; sums by group come back, so groups are limited.
    """
    import pandas as pd

    from ..functions import families
    from ..functions.families import COLUMNS
    from . import generalized
    from .kernels.optimize import lower_bounds, nelder_mead

    fam = families.family(family)
    lk = families.link(fam, link)
    if fam.dispersion:
        raise ModelError("families with a free dispersion are fitted on the driver")
    design = analyze(df, formula)
    design.shift = 0.0
    factors, layout = factors_of(design)
    if len(factors) != 1:
        raise ModelError("a distributed fit has one grouping factor")
    generalized._validate(df, design, fam, weights, None)
    table, e = generalized.compress(df, design, weights)
    rows, spark, f = table.persist(), df.sparkSession, factors[0]
    n, k, p = int(rows.agg(F.sum("rows")).first()[0]), len(f.effects), len(e.x)
    f.labels = sorted((r["g0"] for r in rows.select("g0").distinct().limit(MOST_GROUPS + 1).toLocalIterator()), key=lambda s: s.encode())
    if len(f.labels) > MOST_GROUPS:
        rows.unpersist()
        raise ModelError(f"over {MOST_GROUPS} groups: their sums come to the driver at every iteration")
    index = pd.Index(f.labels)
    y = F.col(f"u{e.y}")
    pairs = sorted(_pairs(e.x + e.z[0], e.x + e.z[0]))

    def sums(state):
        """Products at the weights of ``state`` (None: the family's start), and the deviance there."""
        if state is None:
            base, eta = rows, lk.link(fam.start(y, COLUMNS), COLUMNS) + F.col("off")
        else:
            beta, b = state
            effects = spark.createDataFrame(pd.DataFrame({"g0": f.labels} | {f"b{j}": b[:, j] for j in range(k)}))
            base = rows.join(F.broadcast(effects) if len(f.labels) <= 500_000 else effects, "g0")
            eta = F.col("off")
            for i, v in zip(e.x, beta):
                eta = eta + F.col(f"u{i}") * F.lit(float(v))
            for j, i in enumerate(e.z[0]):
                eta = eta + F.col(f"u{i}") * F.col(f"b{j}")
        base = base.withColumn("eta", eta).withColumn("mu", lk.inverse(F.col("eta"), COLUMNS)).withColumn("me", lk.mu_eta(F.col("eta"), COLUMNS))
        base = base.withColumn("d", fam.deviance(y, F.col("mu"), F.col("w"), COLUMNS)).withColumn("v", F.col("w") * F.col("me") * F.col("me") / fam.variance(F.col("mu"), COLUMNS))
        base = base.withColumn("z", F.col("eta") - F.col("off") + (y - F.col("mu")) / F.col("me")).withColumn("w", F.col("v"))
        got = base.groupBy("g0").agg(F.sum("d").alias("dev"), F.sum(F.col("w") * F.col("z") * F.col("z")).alias("zz"), *[_product(i, j) for i, j in pairs], *[F.sum(F.col("w") * F.col(f"u{i}") * F.col("z")).alias(f"z{i}") for i in sorted({*e.x, *e.z[0]})]).toPandas()
        got = got.iloc[np.argsort(index.get_indexer(got["g0"]))]
        take = lambda left, right: np.stack([np.stack([got[f"p{min(i, j)}_{max(i, j)}"].to_numpy(float) for j in right], axis=-1) for i in left], axis=-2)
        zs = lambda left: np.stack([got[f"z{i}"].to_numpy(float) for i in left], axis=-1)[:, :, None]
        t = np.zeros((p + 1, p + 1))
        t[:p, :p], t[:p, p], t[p, :p], t[p, p] = take(e.x, e.x).sum(0), zs(e.x).sum(0)[:, 0], zs(e.x).sum(0)[:, 0], got["zz"].sum()
        c = np.concatenate([take(e.z[0], e.x), zs(e.z[0])], axis=2)
        return Gram(design.names, n, t, [Factor(f.group, f.effects, f.blocks, f.labels, take(e.z[0], e.z[0]), c)], {}, layout), float(got["dev"].sum())

    last: dict = {"state": None, "u": 0.0}

    def solve(theta):
        state, old, penalty = last["state"], math.inf, 0.0
        for step in range(60):
            gram, dev = sums(state)
            sol = lmm.Solution(gram, theta)
            if state is not None and step and abs(old - dev - penalty) < tol * (abs(dev + penalty) + 0.1):
                last["state"] = state
                return dev + sol.logdet + penalty, state, sol, gram, u
            old = dev + penalty
            beta = np.linalg.solve(sol.s[:p, :p], sol.s[:p, p])
            u = sol.effects(np.concatenate([-beta, [1.0]]))[0]
            state, penalty = (beta, u @ sol.lam[0].T), float((u * u).sum())
        return math.inf, state, sol, gram, u

    if len(lower_bounds(layout)) == 1:
        theta = np.array([parabola(lambda t: solve([t])[0], 0.7)[0]])
    else:
        theta = nelder_mead(lambda t: solve(t)[0], np.where(lower_bounds(layout) == 0, 0.7, 0.0), lower_bounds(layout), step=0.3, tol=1e-6, most=150, restarts=1)[0]
    dev, (beta, b), sol, gram, u = solve(theta)
    rows.unpersist()
    lam = sol.lam[0]
    return FittedModel(
        design=design, kind="glmer", coefficients=beta, v_unscaled=np.linalg.inv(sol.s[:p, :p]), sigma2=None, theta=theta, deviance=dev, reml=False, num_obs=n,
        labels=[f.labels], b=[b], u=[u], covariance=[lam @ lam.T], factors=factors, layout=layout, n_params=len(theta) + p, converged=math.isfinite(dev), family=fam, link=lk, data=df, weights=weights, log_likelihood=-dev / 2,
    )
