"""A running model takes up its sums where a restart left them; grouped draws add up by group."""

import numpy as np
import pandas as pd
import pytest

import stratagram as sg


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    g, h = rng.integers(0, 12, 600), rng.integers(0, 5, 600)
    x = rng.normal(size=600)
    y = 1 + 0.5 * x + rng.normal(size=12)[g] + rng.normal(size=5)[h] + rng.normal(size=600)
    return pd.DataFrame({"y": y, "x": x, "g": [f"grü{v}" for v in g], "h": [f"h{v}" for v in h]})


@pytest.mark.parametrize("formula", ["y ~ x + (1 | g)", "y ~ x + (1 | g) + (1 | h)", "y ~ x"])
def test_running_model_survives_a_restart(spark, frame, tmp_path, formula):
    whole = spark.createDataFrame(frame)
    fit = sg.lmer if "|" in formula else sg.lm
    want = fit(formula, whole)
    parts = [spark.createDataFrame(frame.iloc[i::3]) for i in range(3)]
    path = f"file://{tmp_path}/sums"
    for epoch, part in enumerate(parts):
        running = sg.RunningModel(want.design, path=path)  # each batch after a restart
        assert running.last == epoch - 1
        running.update(part, epoch)
        sg.RunningModel(want.design, path=path).update(part, epoch)  # the batch comes again
    again = sg.RunningModel(want.design, path=path)
    assert again.last == 2 and again.gram.n == 600
    assert again.fit().coefficients == pytest.approx(want.coefficients, abs=1e-6)


def test_crossed_groupings_add_up_and_subtract(spark, frame):
    from stratagram.operators.gram import build_gram

    whole = spark.createDataFrame(frame)
    m = sg.lmer("y ~ x + (1 | g) + (1 | h)", whole)
    parts = [build_gram(spark.createDataFrame(frame.iloc[i::3]), m.design) for i in range(3)]
    total = parts[0].combined(parts[1], 1).combined(parts[2], 1)
    less = total.combined(parts[2], -1)
    for got, rows in ((total, frame), (less, frame.drop(frame.index[2::3]))):
        counts = rows.groupby(["g", "h"]).size()
        (i, j, z) = got.cross[(0, 1)]
        have = {(got.factors[0].labels[a], got.factors[1].labels[b]): v for a, b, v in zip(i, j, z[:, 0, 0])}
        assert len(have) == len(i)
        assert {k: v for k, v in have.items() if v > 0.5} == counts.to_dict()


def test_cross_validation_over_crossed_groupings(spark, frame):
    """Each fold's model is the fit of the other folds' rows, though pairs of groups lie in several folds."""
    frame = frame.assign(part=np.arange(len(frame)) % 7)
    whole = spark.createDataFrame(frame)
    cv = sg.cv_grouped("y ~ x + (1 | g) + (1 | h)", whole, "part", 3)
    got = cv.predictions.select("y", "x", "g", "h", "fold", "oof_prediction").toPandas()
    for k in range(3):
        train, held = got[got["fold"] != k], got[got["fold"] == k]
        m = sg.lmer("y ~ x + (1 | g) + (1 | h)", spark.createDataFrame(train[["y", "x", "g", "h"]]))
        want = m.coefficients[0] + m.coefficients[1] * held["x"]
        assert held["oof_prediction"].to_numpy() == pytest.approx(want.to_numpy(), abs=1e-4)


def test_half_written_state_is_passed_over(spark, frame, tmp_path):
    m = sg.lmer("y ~ x + (1 | g)", spark.createDataFrame(frame))
    path = f"file://{tmp_path}/sums"
    running = sg.RunningModel(m.design, path=path)
    for epoch in range(2):
        running.update(spark.createDataFrame(frame.iloc[epoch::2]), epoch)
    for p in (tmp_path / "sums" / "slot=1").iterdir():
        p.unlink()
    again = sg.RunningModel(m.design, path=path)
    assert again.last == 0 and again.gram.n == 300
    again.update(spark.createDataFrame(frame.iloc[1::2]), 1)
    assert again.fit().deviance == pytest.approx(m.deviance, abs=1e-6)


def test_effects_come_as_a_table(spark, frame):
    m = sg.lmer("y ~ x + (1 + x | g)", spark.createDataFrame(frame))
    got = m.ranef(spark).toPandas().set_index(["effect", "group"])["value"]
    for i, label in enumerate(m.labels[0]):
        for j, effect in enumerate(m.factors[0].effects):
            assert got[(effect, label)] == m.b[0][i, j]
    assert sg.lm("y ~ x", spark.createDataFrame(frame)).ranef(spark).count() == 0


def test_distributed_fit_refuses_too_many_groups(spark, monkeypatch):
    from stratagram.operators import distributed

    monkeypatch.setattr(distributed, "MOST_GROUPS", 3)
    df = spark.createDataFrame([(float(i % 2), f"g{i % 5}") for i in range(40)], "y double, g string")
    with pytest.raises(Exception, match="over 3 groups"):
        distributed.glmer_distributed("y ~ 1 + (1 | g)", df, "binomial")
