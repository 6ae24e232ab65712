"""Nonlinear mixed models with their points in Spark: the fit of the driver."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import stratagram as sg
from stratagram.operators import nonlinear, spread


def test_same_as_on_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(4)
    g, x = np.repeat(np.arange(30), 20), np.tile(np.arange(1.0, 11.0), 60)
    df = spark.createDataFrame(pd.DataFrame({"g": g, "x": x, "y": (100 + 5 * rng.normal(size=30)[g]) * x / (3 + x) + rng.normal(size=600)}))
    for reml in (False, True):
        here = sg.nlmer("y ~ SSmicmen(x, Vmax, K) ~ Vmax | g", df, reml=reml)
        with monkeypatch.context() as m:
            m.setattr(nonlinear, "MOST_LOCAL", 100)
            m.setattr(nonlinear, "points", None)  # nothing comes to the driver
            there = sg.nlmer("y ~ SSmicmen(x, Vmax, K) ~ Vmax | g", df, reml=reml)
        assert there.coefficients == pytest.approx(here.coefficients, rel=1e-6) and there.theta == pytest.approx(here.theta, rel=1e-3)
        assert (there.deviance, there.sigma2, there.num_obs, there.labels) == (pytest.approx(here.deviance, abs=1e-5), pytest.approx(here.sigma2, rel=1e-4), 600, here.labels)
        assert there.b == pytest.approx(here.b, abs=1e-2)


def test_parts_are_whole_groups():
    g = ["a"] * 3 + ["b"] * 9 + ["c"] + ["d"] * 4
    batches = [pa.RecordBatch.from_arrays([pa.array(g[i : i + 2]), pa.array(range(i, min(i + 2, len(g))))], names=["g", "i"]) for i in range(0, len(g), 2)]
    parts = [t["g"].to_pylist() for t in spread.whole_groups(iter(batches), 4)]
    assert sum(parts, []) == g and len(parts) > 1 and sum(len(set(p)) for p in parts) == 4
