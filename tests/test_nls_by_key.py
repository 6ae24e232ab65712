"""Curves by key are those of the rows, however often an x occurs."""

import numpy as np
import pytest

import stratagram as sg


def brute(x, y, steps=200):
    """Gauss-Newton on the rows themselves, halving steps that don't help."""
    b = np.array([y.max(), np.median(x)])
    rss = lambda b: ((y - b[0] * x / (b[1] + x)) ** 2).sum()
    for _ in range(steps):
        g = np.stack([x / (b[1] + x), -b[0] * x / (b[1] + x) ** 2], axis=1)
        step = np.linalg.lstsq(g, y - b[0] * x / (b[1] + x), rcond=None)[0]
        while rss(b + step) > rss(b) and abs(step).max() > 1e-14:
            step = step / 2
        b = b + step
    return b, rss(b)


def test_unequal_replication(spark):
    rng = np.random.default_rng(4)
    rows = []
    for key, many in (("a", 200), ("b", 1), ("c", 30)):
        for x, n in ((1.0, many), (2.0, 1), (4.0, 1), (8.0, 1), (16.0, 2)):
            rows += [(key, x, float(20 * x / (2 + x) + rng.normal(0, 2)), "z") for _ in range(n)]
    df = spark.createDataFrame(rows + [("a", None, 1.0, "z"), ("b", 1.0, None, "z")], "`the key` string, x double, y double, parameters string")
    for r in sg.nls_by_key(df, "the key", "x", "y", "SSmicmen").collect():
        own = np.array([(x, y) for k, x, y, _ in rows if k == r["key"]])
        want, rss = brute(own[:, 0], own[:, 1])
        assert r["parameters"] == pytest.approx(want, rel=1e-4) and r["rss"] == pytest.approx(rss, rel=1e-8) and r["n"] == len(own)


def test_too_many_levels(spark):
    df = spark.range(10_050).selectExpr("cast(id as string) f", "cast(id as double) y")
    with pytest.raises(ValueError, match="over 10000 levels"):
        sg.lm("y ~ f", df)
