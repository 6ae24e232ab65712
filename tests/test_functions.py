import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagram.functions import special
from stratagram.functions.curves import COLUMNS as CC
from stratagram.functions.curves import CURVES, custom_curve, sorted_xy, x_at
from stratagram.functions.families import COLUMNS, FAMILIES, LINKS, NUMPY, family, link


def test_distributions():
    assert special.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert special.f_sf(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-7)
    assert special.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert special.chi2_ppf(0.95, 1) == pytest.approx(3.841458821, abs=1e-7)
    assert special.t_ppf(0.975, 17) == pytest.approx(2.109815578, abs=1e-7)
    assert special.tukey_sf(3.314493, 3) == pytest.approx(0.05, abs=1e-5)
    assert special.tukey_sf(3.88, 3, 10) == pytest.approx(0.05, abs=5e-4)
    assert special.norm_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)


def test_hermite():
    x, w = special.hermite_nodes(7)
    assert w.sum() == pytest.approx(1) and (w * x**4).sum() == pytest.approx(3)


@pytest.mark.parametrize("name", LINKS)
def test_links(name, spark):
    lk, mu = LINKS[name], np.array([0.1, 0.35, 0.5, 0.9])
    eta = lk.link(mu, NUMPY)
    assert lk.inverse(eta, NUMPY) == pytest.approx(mu)
    h = 1e-6
    assert lk.mu_eta(eta, NUMPY) == pytest.approx((lk.inverse(eta + h, NUMPY) - lk.inverse(eta - h, NUMPY)) / (2 * h), rel=1e-5)
    df = spark.createDataFrame([(float(m), float(e)) for m, e in zip(mu, eta)], "mu double, eta double")
    got = np.array(df.select(lk.link(F.col("mu"), COLUMNS), lk.inverse(F.col("eta"), COLUMNS), lk.mu_eta(F.col("eta"), COLUMNS)).collect())
    assert got == pytest.approx(np.stack([eta, mu, lk.mu_eta(eta, NUMPY)], axis=1))


@pytest.mark.parametrize("name", FAMILIES)
def test_families(name, spark):
    fam = FAMILIES[name]
    y, u = np.array([0.2, 0.5, 0.9]), np.array([0.3, 0.5, 0.7])
    d = fam.deviance(y, u, np.ones(3), NUMPY)
    assert (d >= -1e-12).all() and d[1] == pytest.approx(0)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, u)], "y double, u double")
    got = np.array(df.select(fam.deviance(F.col("y"), F.col("u"), F.lit(1.0), COLUMNS), fam.variance(F.col("u"), COLUMNS)).collect())
    assert got == pytest.approx(np.stack([d, fam.variance(u, NUMPY)], axis=1))


def test_family_names():
    assert link(family("Binomial")).name == "logit"
    with pytest.raises(ValueError):
        link(family("poisson"), "probit")
    with pytest.raises(ValueError):
        family("weird")


@pytest.mark.parametrize("name", CURVES)
def test_curve_gradients(name, spark):
    c = CURVES[name]
    p = {"SSlogis": [20, 3, 1.5], "SSasymp": [20, 2, -1], "SSfol": [20, 2, -1], "SSmicmen": [20, 2], "SSgompertz": [20, 2, 0.6], "SSpower": [2, 0.5, 1], "SSfpl": [2, 20, 3, 1.5], "SSbiexp": [3, 1, 2, -1], "SSweibull": [20, 10, -1, 1.2], "SSasympOff": [20, -1, 0.5], "SSasympOrig": [20, -1]}[name]
    x = np.array([0.5, 2.0, 7.0])
    v, g = c.values(x, p)
    for k in range(len(p)):
        lo, hi = list(p), list(p)
        lo[k], hi[k] = p[k] - 1e-5, p[k] + 1e-5
        assert g[:, k] == pytest.approx((c.values(x, hi)[0] - c.values(x, lo)[0]) / 2e-5, rel=1e-4, abs=1e-7)
    df = spark.createDataFrame([(float(t),) for t in x], "x double")
    mu, grad = c.mean(F.col("x"), [F.lit(float(q)) for q in p], CC)
    assert np.array(df.select(mu, *grad).collect()) == pytest.approx(np.concatenate([v[:, None], g], axis=1))
    assert np.allclose(c.self_start(np.linspace(0.5, 15, 30), c.values(np.linspace(0.5, 15, 30), p)[0]), p, rtol=3, atol=15)


def test_curve_helpers():
    ux, uy = sorted_xy([2, 1, 2], [4.0, 1.0, 6.0])
    assert ux.tolist() == [1, 2] and uy.tolist() == [1, 5] and x_at(ux, uy, 3) == pytest.approx(1.5)
    c = custom_curve("line", ["a", "b"], lambda x, p: (p[0] + p[1] * x, (1.0, x)))
    assert c.values(np.array([1.0, 2.0]), [1, 2])[0].tolist() == [3, 5]
    with pytest.raises(ValueError):
        custom_curve("bad", ["a", "b"], lambda x, p: (1.0, (1.0,)))
    assert math.isnan(CURVES["SSpower"].values(np.array([-1.0]), [1, 0.5, 0])[0][0])
