"""Order statistics by counting, against a sort."""

import numpy as np
import pandas as pd
import pytest

import stratagram as sg
from stratagram.operators import model


def at(n):
    return (0, n // 4, n // 2, 3 * n // 4, n - 1) if n else (0,)


@pytest.mark.parametrize("few", [20_000, 3])
def test_against_a_sort(spark, monkeypatch, few):
    monkeypatch.setattr(model, "FEW", few)
    rng = np.random.default_rng(1)
    for v in (rng.normal(size=3001), np.repeat([1.5, -2.0, 7.0], 400), rng.normal(size=500) * 10.0 ** rng.integers(-200, 200, 500), np.array([3.0]), np.r_[-np.inf, rng.normal(size=9), np.inf, np.inf], np.array([-1.7e308, 1.7e308, 0.0, 1.0])):
        df = spark.createDataFrame(pd.DataFrame({"v": v}))
        assert model.order_statistics(df, at) == np.sort(v)[list(at(len(v)))].tolist()
    odd = spark.createDataFrame([(None,), (2.0,), (float("nan"),), (1.0,)], "v double")
    assert model.order_statistics(odd, lambda n: (0, 1)) == [1.0, 2.0] and np.isnan(model.order_statistics(odd, lambda n: (n - 1,))[0])
    assert np.isnan(model.order_statistics(odd.limit(0), at)[0])


def test_residuals_are_not_gathered(spark):
    """No task sorts or keeps the distinct residuals: the sums are of fixed size."""
    df = spark.range(20_000).selectExpr("id * 1.0 AS x", "sin(id) AS y")
    m = sg.lm("y ~ x", df)
    r = np.sort([x["residual"] for x in m.fitted(df).select("residual").collect()])
    seen, real = [], model.F.percentile
    model.F.percentile = lambda *a: seen.append(a) or real(*a)
    try:
        assert m.residual_summary(df) == r[[0, 5000, 10000, 15000, 19999]].tolist()
    finally:
        model.F.percentile = real
    assert not seen
