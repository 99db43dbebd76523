"""Models, neighbours, clusters and forecasts against closed forms and brute force."""

import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import clusters, evaluation, forecast, forest, models, trees
from tablewright.operators.neighbors import nearest
from tablewright.plans.inputs import segment_months
from tablewright.session import scratch_path
from tablewright.sources import sinks, tables

RNG = np.random.default_rng(3)
X = RNG.normal(size=(200, 3)) @ np.array([[1.0, 0.4, 0], [0, 2.0, 0.3], [0, 0, 0.5]])
Y = X @ np.array([2.0, -1.0, 0.5]) + 3 + RNG.normal(scale=0.4, size=200)
NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    pdf = pd.DataFrame(X, columns=NAMES).assign(y=Y, id=np.arange(200), w=np.where(np.arange(200) % 2, 2.0, 0.5))
    return spark.createDataFrame(pdf).persist()


def predicted(fitted, df):
    return np.array([r["prediction"] for r in fitted.predict(df).orderBy("id").collect()])


def ridge(z, y, alpha, w=None):
    w = np.ones(len(y)) if w is None else w
    mx, my = np.average(z, axis=0, weights=w), np.average(y, weights=w)
    zc, yc = z - mx, y - my
    beta = np.linalg.solve(zc.T @ (w[:, None] * zc) + alpha * np.eye(z.shape[1]), zc.T @ (w * yc))
    return my + zc @ beta


Z = (X - X.mean(0)) / X.std(0)


def test_linear_models_equal_closed_forms(data):
    assert np.allclose(predicted(models.fit_model(data, "y", NAMES, "LinearRegression"), data), ridge(Z, Y, 0.0), atol=1e-6)
    assert np.allclose(predicted(models.fit_model(data, "y", NAMES, "Ridge", params={"alpha": 25.0}), data), ridge(Z, Y, 25.0), atol=1e-6)


def test_elastic_net_equals_coordinate_descent(data):
    alpha, l1 = 0.3, 0.5
    beta, yc = np.zeros(3), Y - Y.mean()
    for _ in range(2000):
        for j in range(3):
            rest = yc - Z @ beta + Z[:, j] * beta[j]
            rho = Z[:, j] @ rest / len(Y)
            beta[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / (Z[:, j] @ Z[:, j] / len(Y) + alpha * (1 - l1))
    fitted = models.fit_model(data, "y", NAMES, "ElasticNet", params={"alpha": alpha, "l1_ratio": l1})
    assert np.allclose(predicted(fitted, data), Y.mean() + Z @ beta, atol=1e-4)


def test_weights_and_bayesian_ridge(data):
    w = np.where(np.arange(200) % 2, 2.0, 0.5)
    fitted = models.fit_model(data, "y", NAMES, "LinearRegression", weight="w")
    assert np.allclose(predicted(fitted, data), ridge(Z, Y, 0.0, w), atol=1e-6)
    bayes = predicted(models.fit_model(data, "y", NAMES, "BayesianRidge"), data)
    assert np.abs(bayes - ridge(Z, Y, 0.0)).max() < 0.05 and 1 - ((Y - bayes) ** 2).sum() / ((Y - Y.mean()) ** 2).sum() > 0.9


def test_gaps_are_filled_and_unknown_names_fail(data):
    holes = data.withColumn("a", F.when(F.col("id") % 4 > 0, F.col("a")))
    fitted = models.fit_model(holes, "y", NAMES, "DecisionTree")
    assert fitted.predict(holes).filter("prediction IS NULL").count() == 0
    with pytest.raises(ValueError):
        models.fit_model(data, "y", NAMES, "Oracle")
    with pytest.raises(ValueError):
        fitted.predict(data.drop("b"))


def test_saved_model_predicts_the_same(spark, data):
    fitted = models.fit_model(data, "y", NAMES, "Ridge")
    path = sinks.save_model(spark, fitted.pipeline, scratch_path(spark, "m"), target="y", task="Regression", model="Ridge", features=NAMES)
    loaded, facts = sinks.load_model(spark, path)
    again = np.array([r["prediction"] for r in loaded.transform(data).orderBy("id").collect()])
    assert np.array_equal(again, predicted(fitted, data)) and facts["features"] == NAMES
    with pytest.raises(ValueError):
        sinks.save_model(spark, fitted.pipeline, path + "x", target="y")
    with pytest.raises(ValueError):
        sinks.load_model(spark, scratch_path(spark, "nothing"))


def test_classifiers_give_confidence(data):
    named = evaluation.level_labels(data, "y")
    fitted = models.fit_model(named, "level", NAMES, "LogisticRegression", models.CLASSIFICATION)
    got = fitted.predict(named)
    assert fitted.classes == ["High", "Low", "Medium"] and got.filter("confidence < 0.333 OR confidence > 1").count() == 0
    assert got.filter("prediction = level").count() > 140


def test_failed_model_becomes_a_row(spark):
    rows = spark.range(60).select("id", F.make_timestamp_ntz(F.lit(2000), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("d"), F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    dated = rows.withColumn("d", F.col("d") + F.make_dt_interval(F.col("id").cast("int")))
    got = {r["model"]: r for r in evaluation.evaluate_all_models(dated, "y", ["x"], "d", ["id"], models=["LinearRegression", "Oracle"]).collect()}
    assert got["LinearRegression"]["r2"] > 0.99 and got["Oracle"]["note"].startswith("Model failed") and got["LinearRegression"]["test_rows"] == 12


def test_nearest_equals_brute_force_with_a_hot_point(spark):
    p = pd.DataFrame(np.round(RNG.normal(size=(600, 2)), 1), columns=["a", "b"]).assign(id=np.arange(600))
    p.loc[:200, ["a", "b"]] = 0.5
    q = pd.DataFrame(np.round(RNG.normal(size=(80, 2)), 1), columns=["a", "b"])
    q.loc[:30] = 0.5
    got = nearest(spark.createDataFrame(q), spark.createDataFrame(p), ["a", "b"], 4, "id", "id", leaf_rows=100, slice_rows=20).toPandas()
    for row in q.drop_duplicates().itertuples():
        d = np.sqrt((p.a.to_numpy() - row.a) ** 2 + (p.b.to_numpy() - row.b) ** 2)
        want = np.lexsort((p.id.to_numpy(), d))[:4]
        assert list(got[(got.a == row.a) & (got.b == row.b)].sort_values("rank")["key"]) == list(want)


def test_principal_components_and_quality(spark, data):
    matrix = clusters.feature_matrix(data, NAMES)
    shares = [r["explained"] for r in clusters.pca_variance(matrix, NAMES).collect()]
    assert sum(shares) == pytest.approx(1.0) and shares == sorted(shares, reverse=True)
    spots = clusters.pca_projection(matrix, NAMES).toPandas()
    assert abs(spots[["PC1", "PC2"]].mean()).max() < 1e-9
    split = matrix.withColumn("cluster", (F.col("a") > 0).cast("long"))
    assert clusters.cluster_quality(split, NAMES).first()["davies_bouldin"] > 0
    assert clusters.cluster_quality(split.withColumn("cluster", F.lit(0).cast("long")), NAMES).first()["davies_bouldin"] is None


def test_forest_finds_the_far_point(spark):
    x = pd.DataFrame(RNG.normal(size=(400, 2)), columns=["a", "b"]).assign(id=np.arange(400))
    x.loc[7, ["a", "b"]] = [9.0, -9.0]
    scored = forest.isolation_forest(spark.createDataFrame(x), ["a", "b"], "id", 0.05, trees=40)
    assert forest.most_unusual(scored, "id", 1).first()["id"] == 7
    assert scored.filter("anomaly_label = 'Anomaly'").count() == 20


def test_direct_forecast_stays_in_bounds(spark, sf):
    rows = segment_months(spark, sf)
    made = forecast.direct_forecast(rows, "month", "revenue", [], 4, ["segment"], windows=[], start="1998-01-01")
    got = made.groupBy("segment").agg(F.count("*").alias("n"), F.min("month").alias("first"))
    ends = rows.groupBy("segment").agg(F.max("month").alias("last"))
    assert got.filter("n <> 4").count() == 0 and got.join(ends, "segment").filter("first <= last").count() == 0
    assert made.filter("forecast IS NULL OR monthly_change IS NULL").count() == 0


def test_short_series_come_back_with_a_reason(spark, sf):
    rows = segment_months(spark, sf)
    cut = rows.filter("segment <> 'BUILDING' OR month >= TIMESTAMP_NTZ '2001-01-01'")
    series = rows.select("segment").distinct().count()
    for made in (
        forecast.direct_forecast(cut, "month", "revenue", ["ticket"], 3, ["segment"], windows=[], start="1998-01-01"),
        forecast.recursive_forecast(cut, "month", "revenue", ["ticket"], 3, ["segment"]),
    ):
        got = made.groupBy("segment").agg(F.count("*").alias("n"), F.count("forecast").alias("known"), F.count("reason").alias("told"))
        assert {r["segment"]: (r["n"], r["known"], r["told"]) for r in got.collect()} == {
            s["segment"]: (3, 0, 3) if s["segment"] == "BUILDING" else (3, 3, 0) for s in rows.select("segment").distinct().collect()
        }
        assert got.count() == series
    with pytest.raises(ValueError, match="no linear terms"):
        forecast.linear_terms(models.fit_model(rows, "revenue", ["ticket"], "DecisionTree"))


def test_both_recursions_agree(spark, sf, monkeypatch):
    rows = segment_months(spark, sf)
    ask = (rows, "month", "revenue", ["ticket"], 4, ["segment"])
    fold = {(r["segment"], r["horizon"]): r["forecast"] for r in forecast.recursive_forecast(*ask).collect()}
    monkeypatch.setattr(forecast, "has_linear_terms", lambda fitted: False)
    step = {(r["segment"], r["horizon"]): r["forecast"] for r in forecast.recursive_forecast(*ask).collect()}
    assert fold.keys() == step.keys() and all(step[k] == pytest.approx(v, rel=1e-9) for k, v in fold.items())


@pytest.mark.parametrize("name,params", [("DecisionTree", {"ccp_alpha": 0.0}), ("KNNRegressor", None), ("NeuralNetwork", {"max_iter": 5})])
def test_recursion_equals_a_loop_over_series(spark, sf, monkeypatch, name, params):
    rows, known = segment_months(spark, sf), []

    def noted(*args, **how):
        known.append(models.fit_model(*args, **how))
        return known[0]

    monkeypatch.setattr(forecast, "fit_model", noted)
    made = forecast.recursive_forecast(rows, "month", "revenue", ["ticket"], 3, ["segment"], model=name, params=params, lags=(1, 3), windows=(3,))
    got = {(r["segment"], r["horizon"]): r["forecast"] for r in made.collect()}
    frame = rows.toPandas().sort_values("month")
    series = {s: part["revenue"].astype(float).tolist() for s, part in frame.groupby("segment")}
    held = {s: float(part["ticket"].iloc[-1]) for s, part in frame.groupby("segment")}
    used = known[0].features
    for horizon in (1, 2, 3):
        asked = [(s, v[-1], v[-3], float(np.mean(v[-3:])), v[-1] - v[-2], held[s]) for s, v in series.items()]
        table = spark.createDataFrame(asked, "segment string, " + ", ".join(f"`{c}` double" for c in used))
        for r in known[0].predict(table, "p").collect():
            series[r["segment"]].append(r["p"])
            assert got[(r["segment"], horizon)] == pytest.approx(r["p"], rel=1e-9)


def test_readers_and_paths(spark, sf):
    assert tables.resolve_dataset(spark, [f"{sf}/none.parquet", f"{sf}/orders.parquet"]).endswith("orders.parquet")
    with pytest.raises(ValueError):
        tables.layer_path("/x", "09_none", "t")


def test_malformed_lines_are_kept(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\nnot a number,y\n3,z\n")
    got = tables.read_csv(spark, str(tmp_path / "t.csv"), "a int, b string", corrupt="_bad").cache()
    assert [(r["a"], r["_bad"]) for r in got.orderBy("b").collect()] == [(1, None), (None, "not a number,y"), (3, None)]
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "t.csv"), corrupt="_bad")


def test_weighted_ridge_closed_form(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 2))
    y = x @ [2.0, -1.0] + 3 + rng.normal(size=400) * np.where(x[:, 0] > 0, 4.0, 0.5)
    w = np.where(x[:, 0] > 0, 7.0, 0.2)
    df = spark.createDataFrame([(int(i), *map(float, r), float(t), float(v)) for i, (r, t, v) in enumerate(zip(x, y, w, strict=True))], "i long, a double, b double, y double, w double")
    for alpha in (1.0, 200.0):
        fitted = models.fit_model(df, "y", ["a", "b"], "Ridge", scaler=None, params={"alpha": alpha}, weight="w")
        mx, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
        beta = np.linalg.solve((x - mx).T @ ((x - mx) * w[:, None]) + alpha * np.eye(2), (x - mx).T @ ((y - my) * w))
        got = np.array([r["prediction"] for r in fitted.predict(df).orderBy("i").collect()])
        assert np.abs(got - (my + (x - mx) @ beta)).max() < 1e-6


def test_weighted_bayesian_ridge_follows_the_weights(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=300)
    w = np.where(x > 0, 50.0, 0.02)
    y = np.where(x > 0, 3 * x, -5 * x) + rng.normal(size=300) * 0.1
    df = spark.createDataFrame([(int(i), float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w, strict=True))], "i long, a double, y double, w double")
    fitted = models.fit_model(df, "y", ["a"], "BayesianRidge", scaler=None, weight="w")
    ols = models.fit_model(df, "y", ["a"], "LinearRegression", scaler=None, weight="w")
    pairs = fitted.predict(df, "p").join(ols.predict(df, "q").select("i", "q"), "i").select("p", "q").toPandas()
    assert (pairs["p"] - pairs["q"]).abs().max() < 0.05


@pytest.mark.parametrize("name", ["bayesian_ridge", "decision_tree", "decision_tree_classes", "logistic_regression"])
def test_single_models_see_every_line(spark, sf, name):
    import __spark_entry__ as contract

    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert contract.queries()[name](spark, sf).first()["n"] == rows


def test_diagnosis_and_grid_take_every_model(spark, sf, monkeypatch):
    import __spark_entry__ as contract
    from tablewright.functions import rules

    asked = []
    schema = "model string, train_score double, test_score double, cv_mean double, cv_std double"

    def noted(df, target, features, date_col, tiebreak, task=models.REGRESSION, names=None, params=None, **how):
        chosen = list(how.get("models") or names or models.model_names(task))
        asked.extend((n, how.get("key") in df.columns) for n in chosen)
        return spark.createDataFrame([(n, 0.0, 0.0, 0.0, 0.0) for n in chosen], schema)

    monkeypatch.setattr(evaluation, "diagnose_models", noted)
    contract.queries()["diagnose_fit"](spark, sf)
    assert asked == [(n, True) for n in models.REGRESSORS]
    asked.clear()
    contract.queries()["param_grid"](spark, sf)
    assert set(asked) == {(n, True) for n in models.REGRESSORS if n in rules.PRESETS} and len(asked) == 3 * len(set(asked))


def test_costly_rows_are_dealt_over_all_cores(spark):
    from tablewright.functions.columns import spread_rows

    one = spark.range(100).coalesce(1)
    assert spread_rows(one, 100) is one and spread_rows(one, 99).rdd.getNumPartitions() > 1
    rows = spark.range(70_000).select((F.col("id") % 10).cast("double").alias("a"), F.when(F.col("id") % 10 < 5, "x").otherwise("y").alias("c")).coalesce(1)
    scored = models.fit_model(rows, "c", ["a"], "RandomForest", models.CLASSIFICATION, params={"n_estimators": 3}).predict(rows)
    assert "RoundRobinPartitioning" in scored._jdf.queryExecution().toString() and scored.filter("prediction <> c").count() == 0


def _line(spark):
    x = F.col("id").cast("double")
    return spark.range(40).select("id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("day"), x.alias("x"), (x * 2).alias("y"))


def test_fits_of_a_diagnosis_run_side_by_side(spark, monkeypatch):
    rows = _line(spark)
    meet, fit = threading.Barrier(2, timeout=60), evaluation.fit_model

    def met(*given, **how):
        meet.wait()  # breaks if no other fit is asked for meanwhile
        return fit(*given, **how)

    monkeypatch.setattr(evaluation, "fit_model", met)
    found = evaluation.diagnose_models(rows, "y", ["x"], "day", ["id"], models=["LinearRegression"], folds=3)
    row = found.first()
    assert abs(row["train_score"] - 1) < 1e-9 and abs(row["test_score"] - 1) < 1e-9 and abs(row["cv_mean"] - 1) < 1e-9


def test_an_error_that_is_no_fit_error_ends_a_diagnosis(spark, monkeypatch):
    rows = _line(spark)

    def fit(df, target, features, name, *given, **how):
        raise ValueError("no such model") if name == "Ridge" else OSError("disk")

    monkeypatch.setattr(evaluation, "fit_model", fit)
    unfit = evaluation.diagnose_models(rows, "y", ["x"], "day", ["id"], models=["Ridge"], folds=2).first()
    assert unfit["train_score"] is None and unfit["cv_mean"] is None
    with pytest.raises(OSError):
        evaluation.diagnose_models(rows, "y", ["x"], "day", ["id"], models=["Ridge", "SVR"], folds=2)


def test_presets_share_one_split(spark, monkeypatch):
    rows = _line(spark)
    splits, split = [], evaluation.chronological_split
    monkeypatch.setattr(evaluation, "chronological_split", lambda *given, **how: splits.append(1) or split(*given, **how))
    asked, presets = (rows, "y", ["x"], "day", ["id"]), {"a": {"alpha": 1.0}, "b": {"alpha": 100.0}}
    alone = [tuple(r) for r in evaluation.tune(*asked, "Ridge", presets=presets, folds=3).orderBy("preset").collect()]
    splits.clear()
    with evaluation.trials(*asked, folds=3) as shared:
        found = evaluation.tune(*asked, "Ridge", presets=presets, shared=shared).unionByName(evaluation.tune(*asked, "ElasticNet", presets={"c": {}}, shared=shared))
        found = [tuple(r) for r in found.orderBy("preset").collect()]
    assert len(splits) == 1 and found[:2] == alone and len(found) == 3


def test_forests_are_scored_without_a_change_of_the_session(spark, monkeypatch):
    rows = spark.range(300).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    fitted = models.fit_model(rows, "y", ["x"], "ExtraTrees", params={"n_estimators": 20})
    monkeypatch.setattr(trees, "BLOCK_POINTS", 64)  # several blocks
    whole = {r["x"]: r["prediction"] for r in fitted.predict(rows).collect()}

    def refused(*given):
        raise AssertionError("forests are scored side by side, in one session")

    monkeypatch.setattr(type(spark.conf), "set", refused)
    again = {r["x"]: r["prediction"] for r in fitted.predict(rows.limit(300)).collect()}
    assert again == pytest.approx(whole) and len(again) == 300
