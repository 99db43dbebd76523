"""Quality measures over prediction tables made by closed-form fits."""

from pyspark.sql import functions as F

from tablewright.functions import rules
from tablewright.functions.columns import one_row
from tablewright.operators import metrics, series
from tablewright.plans.inputs import period_sql, PERIODS
from tablewright.functions.labels import period_label
from tablewright.plans.registry import query, rounded, table
from tablewright.plans.tables import each
from tablewright.plans.timeline import level_sql, tertile_sql

PREDICTED = """p AS (SELECT *, l_extendedprice AS y, a * l_quantity + b AS yhat FROM lineitem,
 (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem))"""


def predicted(spark, sf):
    """Price against the price a straight line through quantity gives."""
    lines = table(spark, sf, "lineitem")
    fit = one_row(lines, F.regr_slope("l_extendedprice", "l_quantity").alias("a"), F.regr_intercept("l_extendedprice", "l_quantity").alias("b"))
    return lines.withColumns({"y": F.col("l_extendedprice"), "yhat": F.lit(fit["a"]) * F.col("l_quantity") + F.lit(fit["b"])})


CLASSES = f"""c AS (SELECT l_orderkey, {level_sql('l_extendedprice')} AS actual, l_quantity, l_linenumber FROM lineitem, {tertile_sql('lineitem', 'l_extendedprice')}),
 k AS (SELECT *, {level_sql('l_quantity')} AS predicted FROM c, {tertile_sql('lineitem', 'l_quantity')})"""


def classified(spark, sf):
    """Price level against quantity level."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity", "l_linenumber")
    named = series.tertile_state(lines, "l_extendedprice", "actual")
    return series.tertile_state(named, "l_quantity", "predicted")


SCORES = {"High": "high", "Medium": "medium", "Low": "low"}


def scored(spark, sf):
    return classified(spark, sf).withColumns(
        {"high": F.col("l_quantity"), "low": -F.col("l_quantity"), "medium": -F.abs(F.col("l_quantity") - 25) - F.col("l_linenumber") / 10}
    )


SCORED = CLASSES + """, w AS (SELECT 'High' AS class, l_quantity AS score, actual FROM k UNION ALL SELECT 'Low', -l_quantity, actual FROM k
 UNION ALL SELECT 'Medium', -abs(l_quantity - 25) - l_linenumber / 10, actual FROM k)"""


@query(
    "regression_metrics",
    f"""WITH {PREDICTED} SELECT {period_sql('l_shipdate')} AS time_group, count(*) AS n, round(avg(abs(y - yhat)), 4) AS mae,
 round(sqrt(avg((y - yhat) ** 2)), 4) AS rmse, round(1 - avg((y - yhat) ** 2) / var_pop(y), 6) AS r2 FROM p GROUP BY 1""",
)
def regression_metrics(spark, sf):
    named = predicted(spark, sf).withColumn("time_group", period_label(F.col("l_shipdate"), PERIODS))
    return rounded(rounded(metrics.regression_metrics(named, "y", "yhat", ["time_group"]), 4, ("r2",)), 6)


_PER_CLASS = """l AS (SELECT DISTINCT actual AS label FROM k UNION SELECT DISTINCT predicted FROM k),
 r AS (SELECT label, (SELECT count(*) FROM k WHERE predicted = label) AS called, (SELECT count(*) FROM k WHERE actual = label) AS support,
 (SELECT count(*) FROM k WHERE actual = label AND predicted = label) AS hit FROM l),
 s AS (SELECT *, CASE WHEN called = 0 THEN 0 ELSE hit / called END AS p, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS q FROM r),
 t AS (SELECT *, CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END AS f FROM s)"""


@query(
    "classification_metrics",
    f"""WITH {CLASSES}, {_PER_CLASS} SELECT sum(support)::BIGINT AS n, round(sum(hit) / sum(support), 6) AS accuracy, round(sum(p * support) / sum(support), 6) AS precision,
 round(sum(q * support) / sum(support), 6) AS recall, round(sum(f * support) / sum(support), 6) AS f1 FROM t""",
)
def classification_metrics(spark, sf):
    return rounded(metrics.classification_metrics(classified(spark, sf), "actual", "predicted"), 6)


@query(
    "class_report",
    f"WITH {CLASSES}, {_PER_CLASS} SELECT label, round(p, 6) AS precision, round(q, 6) AS recall, round(f, 6) AS f1, support, hit FROM t",
)
def class_report(spark, sf):
    return rounded(metrics.class_report(classified(spark, sf), "actual", "predicted"), 6)


@query(
    "confusion_matrix",
    f"""WITH {CLASSES}, l AS (SELECT DISTINCT actual AS v FROM k UNION SELECT DISTINCT predicted FROM k)
 SELECT a.v AS actual, b.v AS predicted, count(k.actual) AS n FROM l a CROSS JOIN l b LEFT JOIN k ON k.actual = a.v AND k.predicted = b.v GROUP BY 1, 2""",
)
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(classified(spark, sf), "actual", "predicted")


@query(
    "largest_confusion",
    f"""WITH {CLASSES}, m AS (SELECT actual, predicted, count(*) AS n FROM k WHERE actual <> predicted GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 1)
 SELECT count(*) AS total, count(*) FILTER (k.actual = k.predicted) AS correct, count(*) FILTER (k.actual <> k.predicted) AS errors,
 round(count(*) FILTER (k.actual = k.predicted) / count(*), 6) AS accuracy, any_value(m.actual) AS mistaken, any_value(m.predicted) AS taken_for, any_value(n) AS mistakes FROM k, m""",
)
def largest_confusion(spark, sf):
    return rounded(metrics.largest_confusion(classified(spark, sf), "actual", "predicted"), 6)


_AUC = """x AS (SELECT class, actual = class AS hit, rank() OVER (PARTITION BY class ORDER BY score)
 + (count(*) OVER (PARTITION BY class, score) - 1) / 2 AS rnk FROM w),
 a AS (SELECT class, (sum(rnk) FILTER (hit) - count(*) FILTER (hit) * (count(*) FILTER (hit) + 1) / 2) / (count(*) FILTER (hit) * count(*) FILTER (NOT hit)) AS auc,
 count(*) FILTER (hit) AS support FROM x GROUP BY 1)"""


@query("roc_auc", f"WITH {SCORED}, {_AUC} SELECT class, round(auc, 6) AS auc, support FROM a")
def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(scored(spark, sf), "actual", SCORES), 6)


@query("weighted_auc", f"WITH {SCORED}, {_AUC} SELECT round(sum(auc * support) / sum(support), 6) AS auc FROM a")
def weighted_auc(spark, sf):
    return rounded(metrics.weighted_auc(scored(spark, sf), "actual", SCORES), 6)


@query(
    "binary_auc",
    """WITH w AS (SELECT '1' AS class, n_chars AS score, quality::VARCHAR AS actual FROM labels JOIN documents USING (doc_id)), """
    + _AUC
    + " SELECT round(auc, 6) AS auc FROM a",
)
def binary_auc(spark, sf):
    judged = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(metrics.weighted_auc(judged, "quality", {"1": "n_chars"}), 6)


@query(
    "roc_curve",
    f"""WITH {SCORED}, g AS (SELECT class, score, count(*) FILTER (actual = class) AS p, count(*) FILTER (actual <> class) AS n FROM w GROUP BY 1, 2)
 SELECT class, round(score, 6) AS threshold, round(sum(n) OVER d / sum(n) OVER (PARTITION BY class), 6) AS fpr, round(sum(p) OVER d / sum(p) OVER (PARTITION BY class), 6) AS tpr
 FROM g WINDOW d AS (PARTITION BY class ORDER BY score DESC)""",
)
def roc_curve(spark, sf):
    return rounded(metrics.roc_curve(scored(spark, sf), "actual", SCORES), 6)


@query(
    "prediction_summary",
    """WITH p AS (SELECT l_extendedprice AS y, a * l_quantity + b AS yhat FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS a,
 regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01')),
 f AS (SELECT count(*) AS n, avg(y) AS am, avg(yhat) AS pm, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) ** 2)) AS rmse, 1 - avg((y - yhat) ** 2) / var_pop(y) AS r2 FROM p)
 SELECT n, round(am, 4) AS actual_mean, round(pm, 4) AS predicted_mean, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(r2, 8) AS r2, round(pm - am, 4) AS mean_gap,
 CASE WHEN pm > am THEN 'over-predicts' WHEN pm < am THEN 'under-predicts' ELSE 'matches the mean' END AS direction, round(mae / am, 4) AS mae_share, round(rmse / am, 4) AS rmse_share,
 CASE WHEN r2 >= 0.8 THEN 'Strong' WHEN r2 >= 0.5 THEN 'Moderate' WHEN r2 >= 0.2 THEN 'Weak' WHEN r2 >= 0 THEN 'Very weak' ELSE 'Worse than baseline' END AS quality FROM f""",
)
def prediction_summary(spark, sf):
    lines = table(spark, sf, "lineitem")
    early = lines.filter(F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    fit = one_row(early, F.regr_slope("l_extendedprice", "l_quantity").alias("a"), F.regr_intercept("l_extendedprice", "l_quantity").alias("b"))
    scored = lines.withColumn("yhat", F.lit(fit["a"]) * F.col("l_quantity") + F.lit(fit["b"]))
    return rounded(rounded(metrics.prediction_summary(scored, "l_extendedprice", "yhat"), 4, ("r2",)), 8)


@query(
    "metric_labels",
    f"WITH {CLASSES}, {_PER_CLASS}, z AS (SELECT sum(hit) / sum(support) AS accuracy, sum(f * support) / sum(support) AS f1 FROM t) "
    + each(
        ["accuracy", "f1"],
        "SELECT '{c}' AS metric, round({c}, 3) AS score, CASE WHEN round({c}, 3) >= 0.9 THEN 'Excellent' WHEN round({c}, 3) >= 0.8 THEN 'Strong' "
        "WHEN round({c}, 3) >= 0.65 THEN 'Moderate' WHEN round({c}, 3) >= 0.5 THEN 'Weak' ELSE 'Very weak' END AS quality FROM z",
    ),
)
def metric_labels(spark, sf):
    return metrics.metric_labels(metrics.classification_metrics(classified(spark, sf), "actual", "predicted"), ["accuracy", "f1"])


# One straight line per measure against price: a small family of models scored on two date ranges.
FEATURES = ["l_quantity", "l_discount", "l_tax"]
SPLIT_DAY = "2000-01-01"


def model_scores(spark, sf):
    """(model, train_score, test_score, cv_std) of one-feature lines, trained on the earlier dates."""
    lines = table(spark, sf, "lineitem")
    early = F.col("l_shipdate") < F.lit(SPLIT_DAY).cast("timestamp_ntz")
    fits = one_row(
        lines.filter(early),
        *[f("l_extendedprice", c).alias(f"{n}_{c}") for c in FEATURES for n, f in (("a", F.regr_slope), ("b", F.regr_intercept))],
    )
    y = F.col("l_extendedprice")
    tried = F.array(
        *[F.struct(F.lit(c).alias("model"), (F.lit(fits[f"a_{c}"]) * F.col(c) + F.lit(fits[f"b_{c}"])).alias("p")) for c in FEATURES]
    )
    long = lines.select(early.alias("train"), y.alias("y"), F.explode(tried).alias("m")).select("train", "y", "m.*")
    got = metrics.regression_metrics(long, "y", "p", ["model", "train"])
    return got.groupBy("model").agg(
        F.max(F.when(F.col("train"), F.col("r2"))).alias("train_score"),
        F.max(F.when(~F.col("train"), F.col("r2"))).alias("test_score"),
        F.max(F.when(~F.col("train"), F.col("rmse"))).alias("rmse"),
        F.max(F.when(~F.col("train"), F.col("mae"))).alias("mae"),
    ).withColumn("cv_std", F.lit(None).cast("double"))


def _score(c: str) -> str:
    e = f"(l_extendedprice - (a * {c} + b))"
    return (
        f"SELECT '{c}' AS model, 1 - avg({e} ** 2) FILTER (t) / var_pop(l_extendedprice) FILTER (t) AS train_score, "
        f"1 - avg({e} ** 2) FILTER (NOT t) / var_pop(l_extendedprice) FILTER (NOT t) AS test_score, sqrt(avg({e} ** 2) FILTER (NOT t)) AS rmse, "
        f"avg(abs({e})) FILTER (NOT t) AS mae "
        f"FROM (SELECT *, l_shipdate < TIMESTAMP '{SPLIT_DAY}' AS t FROM lineitem), (SELECT regr_slope(l_extendedprice, {c}) AS a, "
        f"regr_intercept(l_extendedprice, {c}) AS b FROM lineitem WHERE l_shipdate < TIMESTAMP '{SPLIT_DAY}')"
    )


MODEL_SCORES = "ms AS (" + " UNION ALL ".join(_score(c) for c in FEATURES) + ")"
DIAGNOSED = MODEL_SCORES + """, dg AS (SELECT model, train_score, test_score, train_score - test_score AS gap, CASE WHEN train_score >= 0.7 AND train_score - test_score >= 0.1 THEN 'Overfitting risk'
 WHEN train_score < 0.45 AND test_score < 0.45 THEN 'Underfitting risk' WHEN test_score < 0 AND train_score > 0 THEN 'Poor generalization' ELSE 'Reasonable fit' END AS diagnosis,
 test_score - 0.5 * greatest(train_score - test_score, 0) AS adjusted_score FROM ms)"""


@query(
    "diagnose_scores",
    f"WITH {DIAGNOSED} SELECT model, round(train_score, 6) AS train_score, round(test_score, 6) AS test_score, round(gap, 6) AS gap, diagnosis, round(adjusted_score, 6) AS adjusted_score FROM dg",
)
def diagnose_scores(spark, sf):
    return rounded(metrics.diagnose_scores(model_scores(spark, sf)).drop("cv_std", "rmse", "mae"), 6)


@query(
    "champion",
    f"""WITH {DIAGNOSED} SELECT model, round(test_score, 6) AS test_score, diagnosis, round(adjusted_score, 6) AS adjusted_score, (diagnosis = 'Reasonable fit')::BIGINT AS safe
 FROM dg ORDER BY diagnosis = 'Reasonable fit' DESC, dg.adjusted_score DESC, abs(gap), model LIMIT 1""",
)
def champion(spark, sf):
    best = metrics.champion(metrics.diagnose_scores(model_scores(spark, sf)))
    return rounded(best.select("model", "test_score", "diagnosis", "adjusted_score", "safe"), 6)
