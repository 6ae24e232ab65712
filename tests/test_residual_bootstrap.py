"""A residual bootstrap draws from every residual or refuses."""

import pytest
from pyspark.sql import functions as F

import stratagram as sg
from stratagram.operators import resample


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.range(1_200_000).select((F.col("id") % 50).cast("string").alias("g"), (F.col("id") % 7).cast("double").alias("x"), (F.rand(1) + F.col("id") % 50 / 50).alias("y"))
    return sg.lmer("y ~ x + (1 | g)", rows)


def test_all_residuals_of_a_long_table(spark, model, monkeypatch):
    pools, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: pools.append(getattr(value, "size", 0)) or broadcast(self, value))
    assert resample._boot_lmm(model, model.data, 2, "residual", 1) is not None
    assert pools[0] == 1_200_000


def test_refused_beyond_the_limit(model, monkeypatch):
    monkeypatch.setattr(resample, "MOST_RESIDUALS", 1_000_000)
    with pytest.raises(sg.ModelError, match="residual bootstrap"):
        resample._boot_lmm(model, model.data, 2, "residual", 1)
