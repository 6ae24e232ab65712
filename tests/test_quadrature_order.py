"""Quadrature whose grid is too large runs in a lower order."""

import numpy as np
import pandas as pd
import pytest

import stratagram as sg
from stratagram.operators.kernels import glmm


@pytest.fixture(scope="module")
def three(spark):
    rng = np.random.default_rng(3)
    n = 240
    g, x, z = rng.integers(0, 12, n), rng.integers(-1, 2, n), rng.integers(-1, 2, n)
    b = rng.normal(0, 1, (12, 3))
    y = rng.random(n) < 1 / (1 + np.exp(-(0.3 + b[g, 0] + (0.5 + b[g, 1]) * x + b[g, 2] * z)))
    return spark.createDataFrame(pd.DataFrame({"y": y.astype(float), "x": x.astype(float), "z": z.astype(float), "g": [f"g{k}" for k in g]}))


def test_order():
    assert [glmm.grid_order(n, 3, 400) for n in (1, 3, 5, 7, 9, 11)] == [1, 3, 5, 7, 7, 7]
    assert glmm.grid_order(5, 8, 7000) == 3 and glmm.grid_order(11, 6, 400) == 1 and glmm.grid_order(11, 1, 400) == 11


def test_lower_order_is_used(three):
    fit = sg.prepare_glmer("y ~ x + (1 + x + z | g)", three, "binomial", n_agq=9)
    theta = np.array([1, 0, 0, 1, 0, 1.0])
    at = {n: glmm.profile(fit.rows, fit.family, fit.link, theta, n).deviance for n in (1, 7, 9)}
    assert at[9] == at[7] != at[1]


def test_order_is_told(three):
    fit = sg.prepare_glmer("y ~ x + (1 | g) + (1 | z)", three.withColumn("z", three.z.cast("string")), "binomial", n_agq=3)
    with pytest.warns(UserWarning, match="Laplace"):
        m = fit.fit()
    assert m.extra["n_agq"] == 3 and m.extra["n_agq_used"] == 1


def test_nonlinear_order():
    from stratagram.operators.kernels import nlmm

    class Flat(nlmm.Problem):
        def mean(self, beta, b):
            return beta[0] + b.sum(axis=1)[self.d.group] + 0.1 * (b**3).sum(axis=1)[self.d.group], np.ones((len(self.d.y), 3))

    p = Flat.__new__(Flat)
    group = np.repeat([0, 1], 4)
    p.d = type("D", (), {"group": group, "y": np.array([1.0, 2, 3, 4, 2, 3, 1, 5]), "w": np.ones(8), "n": 8})()
    p.k, p.m, p.p, p.reml, p.random = 3, 2, 3, False, [0, 1, 2]
    at = {n: p.criterion(np.eye(3), np.array([2.0, 0, 0]), np.full((2, 3), 0.2), 10.0, n)[0] for n in (1, 7, 9)}
    assert at[9] == at[7] != at[1]
