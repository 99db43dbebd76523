"""Networks: slopes against finite differences, rounds against plain Adam, settings that have an effect."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import models, network

RNG = np.random.default_rng(4)


def numbers(n=600):
    x = RNG.normal(size=(n, 2))
    return pd.DataFrame(x, columns=["a", "b"]).assign(y=500 + 40 * np.abs(x[:, 0]) - 15 * x[:, 1], id=np.arange(n))


@pytest.mark.parametrize("classes", [True, False])
def test_slope_equals_finite_differences(classes):
    rule = network.Training((3, 5, 4, 3 if classes else 1), classes, 0.7, 0.01, 1, 3)
    x, share = RNG.normal(size=(40, 3)), RNG.uniform(0.1, 3, 40)
    y = RNG.integers(0, 3, 40).astype(float) if classes else RNG.normal(size=40)
    theta = rule.start()
    slope = network.loss_and_gradient(theta, rule, x, y, share)[1]
    near = np.zeros_like(theta)
    for i in range(len(theta)):
        off = np.zeros_like(theta)
        off[i] = 1e-6
        near[i] = (network.loss_and_gradient(theta + off, rule, x, y, share)[0] - network.loss_and_gradient(theta - off, rule, x, y, share)[0]) / 2e-6
    assert np.abs(near - slope).max() < 1e-6


def test_first_step_is_adams():
    rule = network.Training((2, 4, 2), True, 0.01, 0.05, 1, 0)
    x, y = RNG.normal(size=(50, 2)), RNG.integers(0, 2, 50).astype(float)
    start = network.State(rule.start(), np.zeros(rule.size), np.zeros(rule.size))
    found = network.slice_round(start, rule, 0, 1, x, y, np.ones(50), np.zeros(50, bool))
    after = network.State.unpacked(found[: -network.FACTS] / 50)
    slope = network.loss_and_gradient(start.theta, rule, x, y, np.ones(50))[1]
    assert np.allclose(after.theta, start.theta - 0.05 * slope / (np.abs(slope) + 1e-8 / np.sqrt(0.001)), atol=1e-6)


@pytest.mark.parametrize("here", [network.SLICE_POINTS, 150])
def test_numbers_are_learned(spark, here):
    df = spark.createDataFrame(numbers()).select(F.col("a").alias("_x0"), F.col("b").alias("_x1"), F.col("y").alias("_label"), F.lit(2.0).alias("_weight"))
    rule = network.Training((2, 32, 1), False, 0.01, 0.02, 40, 0)
    made = network.fit_network(df, ["_x0", "_x1"], rule, here=here)
    again = network.fit_network(df.repartition(5, F.rand()), ["_x0", "_x1"], rule, here=here)
    assert np.allclose(made.theta, again.theta, atol=1e-6)
    out = df.withColumn("p", made.outputs([F.col("_x0"), F.col("_x1")])[0]).agg(F.avg((F.col("p") - F.col("_label")) ** 2), F.var_pop("_label")).first()
    assert out[0] < 0.05 * out[1]


def test_equal_rows_count_by_their_weight(spark):
    frame = pd.DataFrame({"_x0": RNG.normal(size=90), "_label": RNG.integers(0, 2, 90).astype(float), "_weight": RNG.integers(1, 4, 90).astype(float)})
    often = frame.loc[frame.index.repeat(frame["_weight"].astype(int))].assign(_weight=1.0)
    rule = network.Training((1, 6, 2), True, 0.1, 0.01, 15, 1)
    one, two = (network.fit_network(spark.createDataFrame(f), ["_x0"], rule) for f in (frame, often))
    assert np.allclose(one.theta, two.theta, atol=1e-9)
    none = network.fit_network(spark.createDataFrame(frame).filter("_weight < 0"), ["_x0"], rule)
    assert np.array_equal(none.theta, rule.start())


def test_both_tasks_through_the_factory(spark):
    frame = numbers()
    df = spark.createDataFrame(frame.assign(kind=np.where(frame["a"] * frame["b"] > 0, "same", "other")))
    fast = {"learning_rate_init": 0.03, "max_iter": 80}
    fitted = models.fit_model(df, "kind", ["a", "b"], "NeuralNetwork", models.CLASSIFICATION, params=fast)
    got = fitted.predict(df)
    assert set(got.columns) >= {"prediction", "confidence", "score_other", "score_same"}
    assert got.filter("prediction = kind").count() > 0.93 * len(frame)
    assert got.filter("abs(score_same + score_other - 1) > 1e-9 OR confidence < 0.5").count() == 0
    tied = models.fit_model(df, "kind", ["a", "b"], "NeuralNetwork", models.CLASSIFICATION, params={**fast, "alpha": 1e5})
    size = [sum((w**2).sum() for w, _ in network.layers(m.network.theta, m.network.rule.shapes)) for m in (fitted, tied)]
    assert size[1] < 0.1 * size[0]  # classes keep their last weights, so the decay shows in them
    line = models.fit_model(df, "y", ["a", "b"], "NeuralNetwork", params=fast).predict(df)
    assert line.agg(F.avg((F.col("prediction") - F.col("y")) ** 2) / F.var_pop("y")).first()[0] < 0.05
