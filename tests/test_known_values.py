"""Published results on public data sets."""

import numpy as np
import pandas as pd
import pytest

import stratagram as sg

from . import data


@pytest.fixture(scope="module")
def sleep(spark):
    return spark.createDataFrame(pd.DataFrame(data.sleep())).persist()


@pytest.fixture(scope="module")
def pastes(spark):
    return spark.createDataFrame(pd.DataFrame(data.pastes())).persist()


def test_random_slopes(sleep):
    m = sg.lmer("Reaction ~ Days + (Days | Subject)", sleep)
    assert m.theta == pytest.approx([0.966742, 0.015169, 0.230910], abs=1e-4)
    assert m.coefficients == pytest.approx([251.405105, 10.467286], abs=1e-4) and m.beta_se == pytest.approx([6.824597, 1.545790], abs=1e-3)
    assert m.sigma2 == pytest.approx(654.940008, abs=1e-2) and m.reml_criterion == pytest.approx(1743.628272, abs=1e-6)
    m.with_kenward_roger().with_satterthwaite()
    assert m.kenward_roger_dfs == pytest.approx([17, 17], abs=1e-2) and m.satterthwaite_dfs == pytest.approx([17, 17], abs=1e-2)
    assert m.anova("kenward_roger").f_value == pytest.approx([45.852962], abs=1e-3)
    assert m.with_robust_se(cluster_col="Subject").robust_se == pytest.approx([6.632277, 1.502237], abs=1e-4)


def test_intercepts_and_likelihood(sleep):
    m = sg.lmer("Reaction ~ 1 + (1 | Subject)", sleep)
    assert m.theta == pytest.approx([0.807831], abs=1e-5) and m.reml_criterion == pytest.approx(1904.326517, abs=1e-6)
    assert m.beta_se == pytest.approx([9.049936], abs=1e-5) and m.sigma2 == pytest.approx(1958.865177, abs=1e-3)
    ml = sg.lmer("Reaction ~ Days + (Days | Subject)", sleep, reml=False)
    assert ml.deviance == pytest.approx(1751.939344, abs=1e-6) and ml.theta == pytest.approx([0.929191, 0.018166, 0.222643], abs=1e-4)


def test_offset(sleep):
    df = sleep.withColumn("o", sleep["Days"] * 10.0)
    m = sg.lmer("Reaction ~ Days + offset(o) + (Days | Subject)", df)
    assert m.coefficients == pytest.approx([251.405105, 0.467286], abs=1e-4)
    assert m.anova("kenward_roger").f_value == pytest.approx([0.091383], abs=1e-4)


def test_profiles(sleep):
    m = sg.lmer("Reaction ~ Days + (1 | Subject)", sleep, reml=False)
    assert np.array(m.confint(method="profile").as_tuples()) == pytest.approx(np.array([[231.9923, 270.8179], [8.88655, 12.04802]]), abs=1e-3)
    assert np.array(m.confint(method="profile", which="variance").as_tuples()) == pytest.approx(np.array([[26.0071, 52.9360], [27.8138, 34.5911]]), abs=1e-3)


def test_pastes(pastes):
    m = sg.lmer("strength ~ cask + (1 | batch)", pastes).with_kenward_roger()
    assert m.theta == pytest.approx([0.678546], abs=1e-5) and m.coefficients == pytest.approx([59.295, 0.85, 1.425], abs=1e-6)
    assert m.reml_criterion == pytest.approx(296.027774, abs=1e-6) and m.kenward_roger_dfs == pytest.approx([20.0488, 48, 48], abs=1e-3)
    a = m.anova("kenward_roger")
    assert (a.num_df, a.f_value, a.den_df, a.p_value) == ([2], pytest.approx([1.406947], abs=1e-5), pytest.approx([48], abs=1e-3), pytest.approx([0.254806], abs=1e-5))
    e, pairs = m.emmeans("cask"), m.emmeans_pairs("cask")
    assert e.estimate == pytest.approx([59.295, 60.145, 60.72], abs=1e-6) and e.std_error == pytest.approx([0.837667] * 3, abs=1e-5)
    assert pairs.p_adjust == pytest.approx([0.580369, 0.217910, 0.779377], abs=1e-5)
    t = m.glht("cask", adjust="holm")
    assert t.statistic_values == pytest.approx([0.994441, 1.667151, 0.672710], abs=1e-5) and t.p_adjust == pytest.approx([0.640017, 0.286453, 0.640017], abs=1e-5)
    assert m.glht("cask", "dunnett", "bonferroni").p_adjust == pytest.approx([0.640017, 0.190969], abs=1e-5)
    assert m.with_robust_se(cluster_col="batch").robust_se == pytest.approx([0.967922, 1.411878, 1.300582], abs=1e-4)


def test_crossed(spark):
    m = sg.lmer("diameter ~ 1 + (1 | plate) + (1 | sample)", spark.createDataFrame(pd.DataFrame(data.penicillin()))).with_kenward_roger()
    assert m.theta == pytest.approx([1.539676, 3.512519], abs=1e-3) and m.coefficients == pytest.approx([22.972222], abs=1e-6)
    assert m.beta_se == pytest.approx([0.808595], abs=1e-4) and m.sigma2 == pytest.approx(0.302415, abs=1e-5)
    assert m.reml_criterion == pytest.approx(330.860589, abs=1e-5) and m.kenward_roger_dfs == pytest.approx([5.487], abs=1e-3)
