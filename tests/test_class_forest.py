"""Forests for classes over many rows: nodes against brute force, the model against Spark's learner."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import class_forest, metrics, models


def test_nodes_against_brute_force():
    rng = np.random.default_rng(3)
    bins = np.column_stack([rng.integers(0, 6, 300), rng.integers(0, 4, 300)])
    label = np.where(bins[:, 0] > 3, 2, np.where(rng.random(300) < 0.3, 1, bins[:, 1] % 2))
    weight = rng.integers(0, 4, 300).astype(float)
    nodes = class_forest.grow(bins, label, weight, [6, 4], 3, 4, 7, 2, np.random.default_rng(0))

    def check(k, at):
        here, counts = nodes[k], np.bincount(label[at], weights=weight[at], minlength=3)
        assert np.allclose(here["counts"], counts) and counts.sum() >= 7
        gains = {}
        for f in range(2):
            for cut in range(int(bins[:, f].max())):
                left = np.bincount(label[at][bins[at, f] <= cut], weights=weight[at][bins[at, f] <= cut], minlength=3)
                if min(left.sum(), (counts - left).sum()) >= 7:
                    share = [left.sum() / counts.sum(), (counts - left).sum() / counts.sum()]
                    gains[f, cut] = class_forest.gini(counts) - share[0] * class_forest.gini(left) - share[1] * class_forest.gini(counts - left)
        if here["left"] < 0:
            return [here]
        assert here["gain"] == pytest.approx(max(gains.values())) and gains[here["axis"], here["cut"]] == pytest.approx(here["gain"])
        goes = bins[at, here["axis"]] <= here["cut"]
        below = check(here["left"], at[goes]), check(here["left"] + 1, at[~goes])
        assert not (len(below[0]) == len(below[1]) == 1 and below[0][0]["counts"].argmax() == below[1][0]["counts"].argmax())
        return [*below[0], *below[1]]

    assert len(check(0, np.arange(300))) > 4


def test_many_rows_take_points_and_give_a_forest_like_sparks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"a": rng.integers(0, 50, 4000), "b": rng.integers(0, 9, 4000), "c": rng.normal(size=4000).round(1)})
    frame["y"] = np.where(frame.a + 3 * frame.b + rng.normal(size=4000) * 4 > 40, "high", np.where(frame.c > 0.5, "mid", "low"))
    df, p = spark.createDataFrame(frame).repartition(3), {"n_estimators": 30}
    theirs = models.fit_model(df, "y", ["a", "b", "c"], "RandomForest", models.CLASSIFICATION, params=p)
    monkeypatch.setattr(models, "FEW_ROWS", 1000)
    monkeypatch.setattr(models, "spread_rows", lambda rows: pytest.fail("the learner of few rows") if "_label" in rows.columns else rows)
    ours = models.fit_model(df, "y", ["a", "b", "c"], "RandomForest", models.CLASSIFICATION, params=p)
    one, two = (metrics.classification_metrics(m.predict(df), "y", "prediction").first()["accuracy"] for m in (theirs, ours))
    assert ours.predict(df).columns == theirs.predict(df).columns and two == pytest.approx(one, abs=0.02) and two > 0.85
    sizes = [m.pipeline.stages[-2].totalNumNodes for m in (theirs, ours)]
    assert sizes[1] == pytest.approx(sizes[0], rel=0.15)
    shares = [{r["feature"]: r["share"] for r in m.importance().collect()} for m in (theirs, ours)]
    assert all(shares[1][f] == pytest.approx(shares[0][f], abs=6) for f in shares[0])
    scored = ours.predict(df)
    assert scored.filter("abs(score_high + score_low + score_mid - 1) > 1e-9 OR prediction IS NULL").count() == 0
    flat = df.withColumn("a", F.lit(1.0)).withColumn("b", F.lit(2)).withColumn("c", F.lit(0.0))
    assert models.fit_model(flat, "y", ["a", "b", "c"], "RandomForest", models.CLASSIFICATION, params=p).predict(flat).select("prediction").distinct().count() == 1
