"""Gamma models on mean responses: the fit of the rows themselves."""

import numpy as np
import pandas as pd
import pytest

import stratagram as sg
from stratagram.operators import generalized
from stratagram.operators.kernels import glmm


def rows(n=600):
    rng = np.random.default_rng(3)
    g, x = rng.integers(0, 12, n), rng.integers(0, 3, n)
    y = rng.gamma(4.0, np.exp(1.0 + 0.3 * x + 0.4 * np.sin(g)) / 4.0)
    return pd.DataFrame({"g": g, "x": x, "y": np.round(y, 3) + 0.001, "w": rng.integers(1, 4, n).astype(float)})


@pytest.mark.parametrize("weights", [None, "w"])
@pytest.mark.parametrize("n_agq", [1, 5])
def test_same_as_on_rows(spark, weights, n_agq):
    p = generalized.prepare_glmer("y ~ x + (1 | g)", spark.createDataFrame(rows()), "gamma", n_agq=n_agq, link="log", weights=weights)
    assert len(p.rows.y) <= 36 and p.rows.within > 0
    whole = generalized.patterns(p.data, p.design, p.family, weights, pooled=False)
    assert len(whole.y) > 500 and whole.within == 0 and whole.n == p.rows.n == 600
    for theta in (0.0, 0.2, 0.9):
        a, b = (glmm.profile(d, p.family, p.link, np.array([theta]), n_agq) for d in (p.rows, whole))
        assert (a.deviance, a.dev, a.phi) == pytest.approx((b.deviance, b.dev, b.phi), rel=1e-7) and a.beta == pytest.approx(b.beta, rel=1e-6)


def test_more_rows_than_the_driver_solves_on(spark, monkeypatch):
    monkeypatch.setattr(generalized, "MOST_PATTERNS", 36)
    df = spark.createDataFrame(rows())
    m = sg.glmer("y ~ x + (1 | g)", df, "gamma", link="log")
    assert m.num_obs == 600 and m.fixed_names == ["(Intercept)", "x"] and m.labels[0] == sorted(map(str, range(12)))
