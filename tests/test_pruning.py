"""Pruned trees against the cheapest of all subtrees, and settings of the decision tree."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from tablewright.operators import models, pruning
from tablewright.sources import sinks
from tablewright.session import scratch_path


def frame(n=500, seed=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)).round(1)
    y = np.where(x[:, 0] > 0.3, 3.0, 0.0) + x[:, 1] + rng.normal(size=n)
    return pd.DataFrame(x, columns=["a", "b"]).assign(y=y, kind=np.array(["low", "mid", "top"])[np.digitize(y, [0.5, 2.5])], id=np.arange(n), w=rng.integers(1, 4, n).astype(float))


def subtrees(tree, at):
    """All ways to end the branches below a node, as sets of end nodes."""
    yield frozenset([at])
    if tree.feature[at] >= 0:
        for a in subtrees(tree, tree.left[at]):
            for b in subtrees(tree, tree.right[at]):
                yield a | b


@pytest.mark.parametrize("classes", [0, 3])
def test_cheapest_subtree(spark, classes):
    data = frame()
    label = F.col("y") if not classes else F.array_position(F.array(F.lit("low"), F.lit("mid"), F.lit("top")), F.col("kind")) - 1
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(data)).select("features", label.cast("double").alias("_label"), F.col("w").alias("_weight"))
    kind = DecisionTreeClassifier if classes else DecisionTreeRegressor
    model = kind(labelCol="_label", weightCol="_weight", maxDepth=3, maxBins=255).fit(rows)
    tree = pruning.measured(model, rows, classes)
    assert len(tree.feature) == model.numNodes and tree.moments[0, 0] == len(data)
    # leaf moments are those of the rows that Spark's own prediction sends there
    if not classes:
        found = model.transform(rows).groupBy("prediction").agg(F.sum("_weight").alias("w")).collect()
        means = {round(r["prediction"], 6): r["w"] for r in found}
        for at in tree.leaves:
            n, w, s, q = tree.moments[at]
            assert means[round(s / w, 6)] == w
    risk, every = tree.risk, list(subtrees(tree, 0))
    for alpha in (0.0005, 0.003, 0.01, 0.05, 0.3, 10.0):
        closed = pruning.ends(tree, alpha, 2)
        stay, _ = pruning.kept_nodes(tree, closed)
        mine = frozenset(at for at in stay if closed[at])
        costs = {s: sum(risk[at] for at in s) + alpha * len(s) for s in every}
        least = min(costs.values())
        assert mine == min((s for s in every if costs[s] < least + 1e-12), key=len)
    assert len(pruning.kept_nodes(tree, pruning.ends(tree, 0.0, 2))[0]) == model.numNodes


@pytest.mark.parametrize("task,target", [(models.REGRESSION, "y"), (models.CLASSIFICATION, "kind")])
def test_settings_of_the_decision_tree(spark, task, target):
    data = frame()
    df = spark.createDataFrame(data)
    free = {"max_depth": 6, "min_samples_leaf": 1, "min_samples_split": 2, "ccp_alpha": 0.0}

    def leaves(**how):
        fitted = models.fit_model(df, target, ["a", "b"], "DecisionTree", task, params={**free, **how})
        got = fitted.predict(df)
        share = fitted.importance().toPandas()["share"].sum()
        return got.select("prediction" if task == models.REGRESSION else "confidence").distinct().count(), fitted, share

    n, fitted, share = leaves()
    fewer, less = leaves(min_samples_split=120)[0], leaves(ccp_alpha=0.02)[0]
    assert 1 < fewer < n and 1 < less < n and share == pytest.approx(100)
    assert leaves(ccp_alpha=1e6)[0] == 1
    size = fitted.predict(df).groupBy("prediction").count().agg(F.min("count")).first()[0]
    assert size >= 1
    path = sinks.save_model(spark, fitted.pipeline, scratch_path(spark, "tree"), target=target, task=task, model="DecisionTree", features=["a", "b"])
    loaded, _ = sinks.load_model(spark, path)
    both = loaded.transform(df).select("id", F.col("prediction").alias("p")).join(fitted.pipeline.transform(df).select("id", "prediction"), "id")
    assert both.filter("p <> prediction").count() == 0


def test_a_small_node_stays_whole(spark):
    df = spark.createDataFrame(frame())
    fitted = models.fit_model(df, "y", ["a", "b"], "DecisionTree", params={"max_depth": 8, "min_samples_leaf": 1, "min_samples_split": 60, "ccp_alpha": 0.0}, weight="w")
    got = fitted.predict(df)
    means = got.groupBy("prediction").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("m"))
    assert means.filter("abs(m - prediction) > 1e-9").count() == 0
