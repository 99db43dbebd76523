"""Training, scoring, tuning and model bookkeeping."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import rules
from tablewright.operators import evaluation, metrics, models, saved, series
from tablewright.operators.neighbors import knn_predict
from tablewright.plans.inputs import GAPPY_SQL, LINE_KEY, MONTHS_SQL, SEGMENTS_SQL, gappy_lines, months, segment_months
from tablewright.plans.registry import day, query, rounded, table
from tablewright.plans.scoring import MODEL_SCORES, model_scores
from tablewright.plans.timeline import MONTH, OVER, SEGMENT, WINDOWS, level_sql, tertile_sql
from tablewright.session import scratch_path
from tablewright.sources import sinks

DRIVERS = ["l_quantity", "l_discount", "l_tax"]

def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(*LINE_KEY, "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


@query(
    "feature_steps",
    f"""WITH g AS ({GAPPY_SQL}), m AS (SELECT median(l_discount) AS d, median(l_tax) AS t FROM g),
 f AS (SELECT {', '.join(LINE_KEY)}, l_quantity AS q, coalesce(l_discount, d) AS d, coalesce(l_tax, t) AS t FROM g, m),
 s AS (SELECT avg(q) AS qm, stddev_pop(q) AS qs, avg(d) AS dm, stddev_pop(d) AS ds, avg(t) AS tm, stddev_pop(t) AS ts FROM f)
 SELECT {', '.join(LINE_KEY)}, round((q - qm) / qs, 4) AS l_quantity, round((f.d - dm) / ds, 4) AS l_discount, round((f.t - tm) / s.ts, 4) AS l_tax FROM f, s""",
)
def feature_steps(spark, sf):
    lines = gappy_lines(spark, sf)
    step = models.fit_features(lines, DRIVERS)
    return rounded(lines.select(*LINE_KEY, *[c.alias(f) for c, f in zip(step.columns(), DRIVERS, strict=True)]))


def _scores(fitted, df, target="l_extendedprice"):
    """Fit of a model on its own table, in one row."""
    found = metrics.regression_metrics(fitted.predict(df), target, "prediction")
    return found.withColumn("model", F.lit(fitted.name))


@query(
    "linear_regression",
    f"""SELECT {', '.join(LINE_KEY)}, round(regr_intercept(l_extendedprice, l_quantity) OVER () + regr_slope(l_extendedprice, l_quantity) OVER () * l_quantity, 2) AS prediction FROM lineitem""",
)
def linear_regression(spark, sf):
    lines = _lines(spark, sf)
    fitted = models.fit_model(lines, "l_extendedprice", ["l_quantity"], "LinearRegression")
    return rounded(fitted.predict(lines).select(*LINE_KEY, "prediction"), 2)


@query(
    "ridge",
    f"""WITH s AS (SELECT avg(l_discount) AS mx, avg(l_quantity) AS my, covar_pop(l_discount, l_quantity) * count(*) AS xy, var_pop(l_discount) * count(*) AS xx FROM lineitem)
 SELECT {', '.join(LINE_KEY)}, round(my + xy / (xx + 50.0) * (l_discount - mx), 6) AS prediction FROM lineitem, s""",
)
def ridge(spark, sf):
    lines = _lines(spark, sf)
    fitted = models.fit_model(lines, "l_quantity", ["l_discount"], "Ridge", scaler=None, params={"alpha": 50.0})
    return rounded(fitted.predict(lines).select(*LINE_KEY, "prediction"), 6)


@query(
    "elastic_net",
    f"""WITH s AS (SELECT avg(l_quantity) AS mx, stddev_pop(l_quantity) AS sx, avg(l_extendedprice) AS my, covar_pop(l_quantity, l_extendedprice) / stddev_pop(l_quantity) AS c FROM lineitem)
 SELECT {', '.join(LINE_KEY)}, round(my + sign(c) * greatest(abs(c) - 0.05 * 0.2, 0) / (1 + 0.05 * 0.8) * (l_quantity - mx) / sx, 0) AS prediction FROM lineitem, s""",
)
def elastic_net(spark, sf):
    lines = _lines(spark, sf)
    fitted = models.fit_model(lines, "l_extendedprice", ["l_quantity"], "ElasticNet")
    return rounded(fitted.predict(lines).select(*LINE_KEY, "prediction"), 0)


def _own_fit(name):
    """Default settings, on every row of the table."""

    def run(spark, sf):
        lines = _lines(spark, sf)
        return _scores(models.fit_model(lines, "l_extendedprice", DRIVERS, name), lines)

    return run


for _name, _key in (
    ("BayesianRidge", "bayesian_ridge"), ("RandomForest", "random_forest"), ("ExtraTrees", "extra_trees"), ("GradientBoosting", "gradient_boosting"),
    ("HistGradientBoosting", "hist_gradient_boosting"), ("DecisionTree", "decision_tree"), ("SVR", "support_vector"),
):
    query(_key)(_own_fit(_name))


def _own_classes(name):
    def run(spark, sf):
        lines = evaluation.level_labels(_lines(spark, sf), "l_extendedprice")
        fitted = models.fit_model(lines, "level", DRIVERS, name, models.CLASSIFICATION)
        return metrics.classification_metrics(fitted.predict(lines), "level", "prediction").withColumn("model", F.lit(name))

    return run


for _name, _key in (
    ("RandomForest", "random_forest_classes"), ("LogisticRegression", "logistic_regression"), ("DecisionTree", "decision_tree_classes"),
    ("NeuralNetwork", "neural_network"),
):
    query(_key)(_own_classes(_name))


_NEAR = """n AS (SELECT s_suppkey, c_custkey, c_acctbal, c_mktsegment, sqrt((s_acctbal - c.c_acctbal) ** 2 + (s_nationkey - c_nationkey) ** 2) AS d
 FROM supplier, customer c QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY d, c_custkey) <= 5)"""


def _near(spark, sf):
    asked = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    points = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"),
        F.length("c_mktsegment").cast("double").alias("size"),
    )
    return asked, points


@query(
    "knn_join",
    f"WITH {_NEAR} SELECT s_suppkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY d, c_custkey) AS rank, c_custkey, round(d, 4) AS distance FROM n",
)
def knn_join(spark, sf):
    from tablewright.operators.neighbors import nearest

    asked, points = _near(spark, sf)
    found = nearest(asked, points, ["balance", "nation"], 5, "c_custkey", "c_custkey")
    joined = asked.withColumn("nation", F.col("nation").cast("double")).join(found, ["balance", "nation"])
    return rounded(joined.select("s_suppkey", F.col("rank").cast("long").alias("rank"), F.col("key").alias("c_custkey"), "distance"))


@query(
    "knn_regressor",
    f"WITH {_NEAR} SELECT s_suppkey, round(sum(length(c_mktsegment) * w) / sum(w), 4) AS prediction FROM (SELECT *, CASE WHEN min(d) OVER (PARTITION BY s_suppkey) = 0 THEN (d = 0)::INT ELSE 1 / d END AS w FROM n) GROUP BY 1",
)
def knn_regressor(spark, sf):
    asked, points = _near(spark, sf)
    return rounded(knn_predict(asked, points, ["balance", "nation"], "size", "c_custkey", 5, "distance").select("s_suppkey", "prediction"))


@query(
    "knn_classifier",
    f"WITH {_NEAR}, v AS (SELECT s_suppkey, c_mktsegment, count(*) AS votes FROM n GROUP BY 1, 2) SELECT s_suppkey, c_mktsegment AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY votes DESC, c_mktsegment) = 1",
)
def knn_classifier(spark, sf):
    asked, points = _near(spark, sf)
    return knn_predict(asked, points, ["balance", "nation"], "segment", "c_custkey", 5, task=models.CLASSIFICATION).select("s_suppkey", "prediction")


@query(
    "stored_neighbors",
    f"WITH {_NEAR} SELECT s_suppkey, round(avg(length(c_mktsegment)), 4) AS prediction FROM n GROUP BY 1",
)
def stored_neighbors(spark, sf):
    """A nearest-neighbour model, saved with its boxes and loaded again."""
    asked, points = _near(spark, sf)
    fitted = models.fit_model(points, "size", ["balance", "nation"], "KNNRegressor", scaler=None, key="c_custkey")
    path = saved.save_fitted(spark, fitted, scratch_path(spark, "neighbors"), target="size")
    loaded, _ = saved.load_fitted(spark, path)
    return rounded(loaded.predict(asked).select("s_suppkey", "prediction"))


@query(
    "tertile_labels",
    f"""WITH a AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'), b AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')
 SELECT 'train' AS part, o_orderkey, {level_sql('o_totalprice')} AS level FROM a, {tertile_sql('a', 'o_totalprice').replace(' AS a,', ' AS a_,').replace('AS b FROM', 'AS b_ FROM')} x(a, b)
 UNION ALL SELECT 'test', o_orderkey, {level_sql('o_totalprice')} FROM b, {tertile_sql('b', 'o_totalprice').replace(' AS a,', ' AS a_,').replace('AS b FROM', 'AS b_ FROM')} x(a, b)""",
)
def tertile_labels(spark, sf):
    orders = table(spark, sf, "orders")
    early = F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")
    train, test = evaluation.tertile_labels(orders.filter(early), orders.filter(~early), "o_totalprice")
    pick = lambda d, n: d.select(F.lit(n).alias("part"), "o_orderkey", "level")
    return pick(train, "train").unionByName(pick(test, "test"))


@query(
    "supervised_frame",
    f"""SELECT level, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT *, {level_sql('o_totalprice')} AS level FROM orders, {tertile_sql('orders', 'o_totalprice')}) GROUP BY 1""",
)
def supervised_frame(spark, sf):
    framed = evaluation.supervised_frame(table(spark, sf, "orders"), "o_totalprice", ["o_custkey"], models.CLASSIFICATION)
    return rounded(framed.groupBy("level").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query(
    "change_model",
    f"""WITH s AS ({SEGMENTS_SQL}), tr AS (SELECT * FROM s WHERE month < TIMESTAMP '2000-01-01'), c AS (SELECT *, revenue - lag(revenue) {OVER} AS d FROM tr),
 f AS (SELECT regr_slope(d, ticket) AS a, regr_intercept(d, ticket) AS b, CASE WHEN min(d) >= 0 THEN 0 ELSE quantile_cont(d, 0.01) END AS lo, quantile_cont(d, 0.99) AS hi FROM c WHERE d IS NOT NULL),
 l AS (SELECT segment, arg_max(revenue, month) AS last FROM tr GROUP BY 1)
 SELECT segment, {MONTH}, revenue, round(last + sum(least(greatest(a * ticket + b, lo), hi)) {OVER}, 2) AS prediction FROM (SELECT * FROM s WHERE month >= TIMESTAMP '2000-01-01') JOIN l USING (segment), f""",
)
def change_model(spark, sf):
    rows = segment_months(spark, sf)
    early = F.col("month") < F.lit("2000-01-01").cast("timestamp_ntz")
    train, test = rows.filter(early), rows.filter(~early)
    change = models.fit_change_model(models.change_steps(train, "revenue", ["month"], SEGMENT, "month"), ["ticket"], "LinearRegression")
    last = models.last_level(train, "revenue", ["month"], SEGMENT)
    scored = change.predict(test, last, ["month"], SEGMENT, "month")
    return rounded(scored.select("segment", day("month").alias("month"), "revenue", "prediction"), 2)


@query(
    "weighted_fit",
    """WITH r AS (SELECT max(o_orderdate) - INTERVAL 36 MONTH AS recent FROM orders),
 w AS (SELECT o_orderkey, o_custkey::DOUBLE AS x, o_totalprice AS y, CASE WHEN o_orderdate >= recent THEN 2.0 WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 1.35 ELSE 0.45 END::DOUBLE AS w FROM orders, r),
 m AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w),
 f AS (SELECT sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) ** 2) AS a FROM w, m)
 SELECT o_orderkey, round(my + a * (x - mx), 2) AS prediction FROM w, m, f""",
)
def weighted_fit(spark, sf):
    orders = series.regime_weights(table(spark, sf, "orders"), "o_orderdate", "1998-01-01")
    fitted = models.fit_model(orders, "o_totalprice", ["o_custkey"], "LinearRegression", weight="weight")
    return rounded(fitted.predict(orders).select("o_orderkey", "prediction"), 2)


def _evaluate(spark, sf, task):
    rows = segment_months(spark, sf).withColumn("row_key", F.xxhash64("segment", "month"))
    return evaluation.evaluate_all_models(
        rows, "revenue", ["orders", "ticket"], "month", SEGMENT, task,
        windows=WINDOWS, start="1998-01-01", resume="1998-08-01", key="row_key", keys=SEGMENT, grain="month",
    )


@query("evaluate_all_models")
def evaluate_all_models(spark, sf):
    return _evaluate(spark, sf, models.REGRESSION)


@query("evaluate_classifiers")
def evaluate_classifiers(spark, sf):
    return _evaluate(spark, sf, models.CLASSIFICATION)


@query("fit_best_model")
def fit_best_model(spark, sf):
    lines = _lines(spark, sf)
    fitted, split = evaluation.fit_best_model(lines, "l_extendedprice", DRIVERS, "l_shipdate", LINE_KEY, "DecisionTree")
    scored = fitted.predict(lines.filter(~split.train))
    return rounded(metrics.regression_metrics(scored, "l_extendedprice", "prediction"))


@query("feature_importance")
def feature_importance(spark, sf):
    return models.fit_model(_lines(spark, sf), "l_extendedprice", DRIVERS, "DecisionTree").importance()


@query("permutation_importance")
def permutation_importance(spark, sf):
    orders = table(spark, sf, "orders").withColumn("order_year", F.year("o_orderdate"))
    fitted = models.fit_model(orders, "o_totalprice", ["o_custkey", "order_year"], "DecisionTree", params={"min_samples_leaf": 20})
    return evaluation.permutation_importance(fitted, orders, "o_totalprice", "o_orderkey")


def _keyed_lines(spark, sf):
    return _lines(spark, sf).withColumn("row_key", F.xxhash64(*LINE_KEY))


@query("diagnose_fit")
def diagnose_fit(spark, sf):
    return rounded(evaluation.diagnose_models(_keyed_lines(spark, sf), "l_extendedprice", DRIVERS, "l_shipdate", LINE_KEY, key="row_key"))


@query("param_grid")
def param_grid(spark, sf):
    lines, names = _keyed_lines(spark, sf), [n for n in models.model_names(models.REGRESSION) if n in rules.PRESETS]
    asked = (lines, "l_extendedprice", DRIVERS, "l_shipdate", LINE_KEY)
    with evaluation.trials(*asked) as shared:
        parts = [evaluation.tune(*asked, name, key="row_key", shared=shared) for name in names]
    return rounded(reduce(DataFrame.unionByName, parts))


@query("batch_score")
def batch_score(spark, sf):
    lines = evaluation.level_labels(_lines(spark, sf), "l_extendedprice")
    fitted = models.fit_model(lines, "level", DRIVERS, "LogisticRegression", models.CLASSIFICATION)
    return fitted.predict(lines).select(*LINE_KEY, "level", "prediction", "confidence")


@query(
    "score_defaults",
    f"WITH g AS ({GAPPY_SQL}) SELECT median(l_quantity) AS l_quantity, median(l_discount) AS l_discount, median(l_tax) AS l_tax, 0.0::DOUBLE AS l_note FROM g",
)
def score_defaults(spark, sf):
    return models.score_defaults(gappy_lines(spark, sf), ["l_quantity", "l_discount", "l_tax", "l_note"])


SCENARIOS = [("Busier", {"orders": 10.0}), ("Quieter", {"orders": -10.0})]


@query(
    "what_if_scoring",
    f"""WITH s AS ({SEGMENTS_SQL}), f AS (SELECT regr_slope(revenue, orders) AS a, regr_intercept(revenue, orders) AS b FROM s),
 l AS (SELECT segment, arg_max(orders, month) AS orders FROM s GROUP BY 1), k(scenario, delta) AS (VALUES ('Baseline', 0.0::DOUBLE), ('Busier', 10.0), ('Quieter', -10.0))
 SELECT segment, scenario, orders + k.delta AS orders, round(b + a * (orders + k.delta), 2) AS predicted, round(b + a * orders, 2) AS baseline, round(a * k.delta, 2) AS delta FROM l, f, k""",
)
def what_if_scoring(spark, sf):
    rows = segment_months(spark, sf)
    fitted = models.fit_model(rows, "revenue", ["orders"], "LinearRegression")
    return rounded(models.what_if(rows, fitted, SCENARIOS, ["month"], SEGMENT), 2)


@query(
    "experiment_log",
    f"""WITH {MODEL_SCORES} SELECT format('EXP-{{:03d}}', row_number() OVER (ORDER BY model)) AS experiment, 'l_extendedprice' AS target, model, round(test_score, 6) AS r2,
 round(rmse, 4) AS rmse, round(mae, 4) AS mae, 1::BIGINT AS feature_count FROM ms""",
)
def experiment_log(spark, sf):
    scores = model_scores(spark, sf).select("model", F.col("test_score").alias("r2"), "rmse", "mae")
    path = sinks.append_log(evaluation.experiment_rows(scores, "l_extendedprice", 1), scratch_path(spark, "experiments"))
    return rounded(rounded(spark.read.parquet(path).drop("run_id", "logged_at"), 4, ("r2",)), 6)


@query(
    "model_registry",
    f"""WITH {MODEL_SCORES} SELECT 'Champion Candidate' AS role, model, 'l_extendedprice' AS target, 'r2' AS metric, round(test_score, 6) AS value, 'Ready for review' AS status
 FROM ms ORDER BY test_score DESC, model LIMIT 1""",
)
def model_registry(spark, sf):
    scores = model_scores(spark, sf).select("model", F.col("test_score").alias("r2"))
    return rounded(evaluation.registry_row(scores, "l_extendedprice", "r2"), 6)


@query(
    "model_sink",
    f"""SELECT {', '.join(LINE_KEY)}, round(regr_intercept(l_extendedprice, l_quantity) OVER () + regr_slope(l_extendedprice, l_quantity) OVER () * l_quantity, 2) AS prediction,
 'l_extendedprice' AS target FROM lineitem""",
)
def model_sink(spark, sf):
    lines = _lines(spark, sf)
    fitted = models.fit_model(lines, "l_extendedprice", ["l_quantity"], "LinearRegression")
    path = sinks.save_model(
        spark, fitted.pipeline, scratch_path(spark, "model"), target="l_extendedprice", task=fitted.task, model=fitted.name, features=fitted.features
    )
    loaded, facts = sinks.load_model(spark, path)
    return rounded(loaded.transform(lines).select(*LINE_KEY, "prediction", F.lit(facts["target"]).alias("target")), 2)
