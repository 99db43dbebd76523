"""Isolation forests: the trees are walked once for each row."""

import numpy as np
import pandas as pd

from tablewright.operators import forest


def test_scores_are_not_computed_again_by_what_reads_them(spark):
    x = np.vstack([np.random.default_rng(4).normal(size=(300, 2)), [[9.0, 9.0]]])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=np.arange(len(x))))
    made = forest.isolation_forest(df, ["a", "b"], "id", trees=10)
    assert "EvalPython" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.columns == ["a", "b", "id", "anomaly_score", "anomaly_label"]
    assert made.orderBy("anomaly_score").first()["id"] == 300
    assert made.filter("anomaly_score < 0").count() == 15
