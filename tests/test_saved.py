"""Saved models of every kind predict the same once loaded; stored neighbours read only boxes that are reached."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import models, neighbors, saved
from tablewright.session import scratch_path


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2)).round(1)
    frame = pd.DataFrame(x, columns=["a", "b"]).assign(id=np.arange(300), y=x[:, 0] * 3 + x[:, 1] ** 2, kind=np.where(x[:, 0] > 0, "up", "down"))
    return spark.createDataFrame(frame).withColumn("a", F.when(F.col("id") != 7, F.col("a"))).persist()


SMALL = {"ExtraTrees": {"n_estimators": 5}, "GradientBoosting": {"n_estimators": 5}, "NeuralNetwork": {"max_iter": 5}, "SVR": {"width": 20}, "RandomForest": {"n_estimators": 5}}


@pytest.mark.parametrize(
    "name,task",
    [(n, models.REGRESSION) for n in ("Ridge", "BayesianRidge", "DecisionTree", "ExtraTrees", "GradientBoosting", "SVR", "KNNRegressor", "NeuralNetwork")]
    + [(n, models.CLASSIFICATION) for n in ("DecisionTree", "KNNClassifier", "NeuralNetwork", "LogisticRegression")],
)
def test_round_trip(spark, data, name, task):
    target = "y" if task == models.REGRESSION else "kind"
    fitted = models.fit_model(data, target, ["a", "b"], name, task, params=SMALL.get(name), key="id")
    path = saved.save_fitted(spark, fitted, scratch_path(spark, "fitted"), target=target)
    loaded, facts = saved.load_fitted(spark, path)
    assert facts == {"target": target} and loaded.classes == fitted.classes
    assert saved.same_scores(fitted, loaded, data, "id")
    if name in ("DecisionTree", "ExtraTrees"):
        assert loaded.importance().collect() == fitted.importance().collect()


def test_stored_boxes_are_pruned(spark):
    rng = np.random.default_rng(5)
    p = pd.DataFrame(rng.uniform(size=(4000, 2)).round(3), columns=["a", "b"]).assign(id=np.arange(4000))
    points = spark.createDataFrame(p)
    made = neighbors.lay_out(points, ["a", "b"], 3, "id", "id", leaf_rows=100)
    kept = neighbors.load(spark, neighbors.store(made, scratch_path(spark, "layout")))
    assert kept.tree.leaves >= 32 and kept.placed.count() == made.placed.count()
    q = spark.createDataFrame(pd.DataFrame(rng.uniform(0.1, 0.14, size=(40, 2)), columns=["a", "b"]))
    asked = q.withColumn("_leaf", kept.box_of())
    read = kept.reached(asked)
    folders = {r[0] for r in read.select("_leaf").distinct().collect()}
    assert 0 < len(folders) <= 4 and read.count() < 500
    assert "PartitionFilters: [" in read._jdf.queryExecution().executedPlan().toString()
    got = neighbors.ask_layout(kept, q, 3).toPandas()
    at, rows = q.toPandas().to_numpy(), p[["a", "b"]].to_numpy()
    for x in at:
        d = np.sqrt(((rows - x) ** 2).sum(axis=1))
        best = np.lexsort((p["id"], d))[:3]
        mine = got[(got["a"] == x[0]) & (got["b"] == x[1])].sort_values("rank")
        assert mine["key"].tolist() == best.tolist()
    with pytest.raises(ValueError, match="holds 3"):
        neighbors.ask_layout(kept, q, 4)


def test_folders_that_are_not_whole(spark):
    with pytest.raises(ValueError, match="not a model folder"):
        saved.load_fitted(spark, scratch_path(spark, "none"))
    empty = neighbors.lay_out(spark.createDataFrame([], "a double, id long"), ["a"], 2, "id", "id")
    kept = neighbors.load(spark, neighbors.store(empty, scratch_path(spark, "empty")))
    assert neighbors.ask_layout(kept, spark.createDataFrame([(1.0,)], "a double"), 2).count() == 0
