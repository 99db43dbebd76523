"""Support vector regression against its optimality conditions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import kernel, models


def data(n=240, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] + rng.normal(size=n) * 0.2
    return pd.DataFrame(x, columns=["_x0", "_x1"]).assign(_label=y, _weight=rng.integers(1, 3, n).astype(float))


@pytest.mark.parametrize("C,epsilon,here", [(1.0, 0.1, 1000), (5.0, 0.3, 1000), (5.0, 0.3, 10)])
def test_optimality_conditions(spark, C, epsilon, here):
    frame = data()
    made = kernel.fit_svr(spark.createDataFrame(frame).repartition(3), ["_x0", "_x1"], C, epsilon, "scale", 40, 1, here=here)
    x, y, weight = frame[["_x0", "_x1"]].to_numpy(), frame["_label"].to_numpy(), frame["_weight"].to_numpy()
    z = made.lift(x)
    r = y - z @ made.weights - made.intercept
    corner = kernel.NARROW * epsilon
    share = C * weight * kernel.slope(r, epsilon, corner)
    # stationarity: the weights are the rows' shares, and the shares balance for the free intercept
    assert np.allclose(made.weights, z.T @ share, atol=1e-4) and abs(share.sum()) < 1e-4
    assert (share[np.abs(r) < epsilon] == 0).all()
    outside = np.abs(r) > epsilon + corner
    assert np.allclose(np.abs(share[outside]), C * weight[outside]) and 0 < outside.sum() < len(r)
    # the dual value of these shares meets the objective but for what the rounded corner costs the rows on the edge
    edge = (np.abs(r) > epsilon) & ~outside
    primal = 0.5 * made.weights @ made.weights + C * (weight * np.maximum(np.abs(r) - epsilon, 0)).sum()
    lifted = z.T @ share
    dual = share @ y - epsilon * np.abs(share).sum() - 0.5 * lifted @ lifted
    assert -1e-4 < primal - dual <= C * weight[edge].sum() * corner / 4 + 1e-4 < 2e-2 * primal


def objective(held, theta, rule):
    r = held.y - held.z @ theta
    return 0.5 * theta[:-1] @ theta[:-1] + rule.C * (held.weight * kernel.rounded_loss(r, rule.epsilon, kernel.NARROW * rule.epsilon)).sum()


def test_the_rows_near_the_edges_settle_the_rest(spark, monkeypatch):
    """Few passes over all rows, and the optimum of all rows."""
    frame = data(3000, 3).assign(_label=lambda d: d["_label"] * 1000)
    passes = []
    summed = kernel.Spread.summed
    monkeypatch.setattr(kernel.Spread, "summed", lambda self, compute, size: passes.append(size) or summed(self, compute, size))
    monkeypatch.setattr(kernel.Held, "limit", 200)
    df = spark.createDataFrame(frame).repartition(3)
    made = kernel.fit_svr(df, ["_x0", "_x1"], 5.0, 0.1, "scale", 30, 1, here=600)
    x, y, weight = frame[["_x0", "_x1"]].to_numpy(), frame["_label"].to_numpy(), frame["_weight"].to_numpy()
    z = made.lift(x)
    monkeypatch.setattr(kernel.Held, "limit", len(x))
    whole = kernel.Held(np.column_stack([z, np.ones(len(x))]), y, weight)
    rule = kernel.Rule(5.0, 0.1, 1e-6, 60)
    plain = kernel.solve(whole, np.append(np.zeros(30), y.mean()), kernel.corners_of(y.std(), 0.1), rule, np.zeros(31))
    assert objective(whole, np.append(made.weights, made.intercept), rule) == pytest.approx(objective(whole, plain, rule), rel=1e-10)
    assert len(passes) < 40


def test_rows_that_come_to_an_edge_are_not_left_out():
    """A linear rest that would not hold is refused, and the steps over all rows end at the optimum."""
    rng = np.random.default_rng(5)
    z = np.column_stack([rng.normal(size=(400, 3)), np.ones(400)])
    held = kernel.Held(z, z @ np.array([3.0, -2.0, 1.0, 4.0]) + rng.normal(size=400), np.ones(400))
    held.limit = 40
    rule, start = kernel.Rule(10.0, 0.1, 1e-6, 60), np.zeros(4)
    assert kernel.settled(held, start, 1e-3, [1e-4, 1e-5], rule, np.zeros(4)) is None
    theta = kernel.solve(held, start, kernel.corners_of(5.0, 0.1), rule, np.zeros(4))
    held.limit = len(z)
    plain = kernel.solve(held, start, kernel.corners_of(5.0, 0.1), rule, np.zeros(4))
    assert objective(held, theta, rule) == pytest.approx(objective(held, plain, rule), rel=1e-10)


def test_settings_have_an_effect(spark):
    frame = data(300, 4).rename(columns={"_x0": "a", "_x1": "b", "_label": "y"}).drop(columns="_weight")
    df = spark.createDataFrame(frame).coalesce(1)
    fit = lambda **p: models.fit_model(df, "y", ["a", "b"], "SVR", params={"width": 60, **p}).predict(df).toPandas()
    plain, wide, weak, sharp = fit(), fit(epsilon=0.8), fit(C=0.01), fit(gamma=30.0)
    error = lambda d: float(((d.y - d.prediction) ** 2).mean())
    assert error(plain) < 0.25 * frame.y.var() and error(plain) < error(wide) and error(plain) < error(weak)
    assert not np.allclose(plain.prediction, sharp.prediction)
    auto = fit(gamma="auto")
    assert np.allclose(plain.prediction, auto.prediction, atol=0.05)  # scaled features: nearly the same width


def test_gamma_scale_is_the_variance_of_all_values(spark):
    df = spark.createDataFrame([(0.0, 10.0), (2.0, 14.0)], "a double, b double")
    values = np.array([0.0, 10.0, 2.0, 14.0])
    drawn = kernel.draw_kernel(df, ["a", "b"], "scale", 50_000, 0)
    assert drawn.directions.std() == pytest.approx(np.sqrt(2 / (2 * values.var())), rel=0.02)


def test_constant_target(spark):
    df = spark.range(30).select(F.col("id").cast("double").alias("a"), F.lit(7.0).alias("y"))
    scored = models.fit_model(df, "y", ["a"], "SVR", params={"width": 10}).predict(df)
    assert scored.filter("abs(prediction - 7) > 0.11").count() == 0


def test_many_rows_are_passed_a_few_times_and_the_rest_is_solved_near_the_edges(spark, monkeypatch):
    """Three passes over all rows after a start from some of them; the optimum is that of all rows."""
    frame = data(6000, 9).assign(_label=lambda d: d["_label"] * 1000)
    passes, sizes = [], []
    summed, spread = kernel.Spread.summed, kernel.Spread.__init__

    def made(self, rows, names, known, limit):
        spread(self, rows, names, known, limit)
        self.place = len(sizes)
        sizes.append(rows.count())

    monkeypatch.setattr(kernel.Spread, "__init__", made)
    monkeypatch.setattr(kernel.Spread, "summed", lambda self, compute, size: passes.append(self.place) or summed(self, compute, size))
    found = kernel.fit_svr(spark.createDataFrame(frame).repartition(3), ["_x0", "_x1"], 5.0, 0.1, "scale", 20, 1, here=500)
    assert sizes[0] == 6000 and len(sizes) > 1 and all(n <= 0.25 * 6000 for n in sizes[1:])
    assert passes.count(0) <= 6 and len(sizes) <= 10  # rings and crossings, up to three times; one more pass each keeps the rows near the edges
    x, y, weight = frame[["_x0", "_x1"]].to_numpy(), frame["_label"].to_numpy(), frame["_weight"].to_numpy()
    monkeypatch.setattr(kernel.Held, "limit", len(x))
    whole = kernel.Held(np.column_stack([found.lift(x), np.ones(len(x))]), y, weight)
    rule = kernel.Rule(5.0, 0.1, 1e-6, 60)
    plain = kernel.solve(whole, np.append(np.zeros(20), y.mean()), kernel.corners_of(y.std(), 0.1), rule, np.zeros(21))
    assert objective(whole, np.append(found.weights, found.intercept), rule) == pytest.approx(objective(whole, plain, rule), rel=1e-10)
