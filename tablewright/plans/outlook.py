"""Forecasts, segments, anomalies and report facts."""

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from tablewright.operators import cleaning, clusters, correlation, facts, forecast, forest, profile, series
from tablewright.plans.cubes import THEORIES
from tablewright.plans.inputs import GAPPY_SQL, LINE_KEY, MONTHS_SQL, SEGMENTS_SQL, gappy_lines, months, segment_months
from tablewright.plans.profiling import COLS, DRIFT_SQL, drift_sql
from tablewright.plans.registry import day, query, rounded, table
from tablewright.plans.scoring import MODEL_SCORES, model_scores
from tablewright.plans.tables import each
from tablewright.plans.timeline import PERIODS, SEGMENT, VERDICTS, WINDOWS, verdict_sql


@query("direct_forecast")
def direct_forecast(spark, sf):
    made = forecast.direct_forecast(
        segment_months(spark, sf), "month", "revenue", ["ticket"], 12, SEGMENT, windows=WINDOWS, start="1998-01-01"
    )
    return rounded(made.withColumn("month", day("month")), 2)


@query("recursive_forecast")
def recursive_forecast(spark, sf):
    made = forecast.recursive_forecast(segment_months(spark, sf), "month", "revenue", ["ticket"], 12, SEGMENT)
    return rounded(made.withColumn("month", day("month")), 2)


@query("recursive_forecast_tree")
def recursive_forecast_tree(spark, sf):
    made = forecast.recursive_forecast(segment_months(spark, sf), "month", "revenue", ["ticket"], 12, SEGMENT, model="DecisionTree")
    return rounded(made.withColumn("month", day("month")), 2)


def _points(spark, sf, scale=True):
    return clusters.feature_matrix(table(spark, sf, "events"), ["value", "user_id"], scale, ["event_id"])


@query(
    "feature_matrix",
    """WITH s AS (SELECT avg(value) AS a, stddev_pop(value) AS b, avg(user_id) AS c, stddev_pop(user_id) AS d FROM events)
 SELECT event_id, round((value - a) / b, 6) AS value, round((user_id - c) / d, 6) AS user_id FROM events, s""",
)
def feature_matrix(spark, sf):
    return rounded(_points(spark, sf), 6)


@query("kmeans_segments")
def kmeans_segments(spark, sf):
    found = clusters.kmeans_segments(_points(spark, sf), ["value", "user_id"], 3)
    return rounded(clusters.segment_profile(found, ["value", "user_id"]))


@query("dbscan")
def dbscan(spark, sf):
    found = clusters.dbscan(_points(spark, sf), ["value", "user_id"], "event_id", 0.1, 8)
    return found.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.col("core").cast("int")).cast("long").alias("core"))


@query(
    "pca",
    """WITH s AS (SELECT var_pop(l_quantity) AS a, var_pop(l_linenumber) AS b, covar_pop(l_quantity, l_linenumber) AS c FROM lineitem),
 e AS (SELECT a + b AS t, ((a + b) + sqrt((a - b) ** 2 + 4 * c ** 2)) / 2 AS big FROM s)
 SELECT 'PC1' AS component, round(big / t, 6) AS explained, round(big / t, 6) AS cumulative FROM e UNION ALL SELECT 'PC2', round(1 - big / t, 6), 1.0 FROM e""",
)
def pca(spark, sf):
    matrix = clusters.feature_matrix(table(spark, sf, "lineitem"), ["l_quantity", "l_linenumber"], False)
    return rounded(clusters.pca_variance(matrix, ["l_quantity", "l_linenumber"]), 6)


@query("pca_projection")
def pca_projection(spark, sf):
    return rounded(clusters.pca_projection(_points(spark, sf), ["value", "user_id"]).select("event_id", "PC1", "PC2"))


@query("isolation_forest")
def isolation_forest(spark, sf):
    scored = forest.isolation_forest(_points(spark, sf), ["value", "user_id"], "event_id")
    return rounded(forest.most_unusual(scored, "event_id").select("event_id", "anomaly_score", "anomaly_label"))


@query(
    "cluster_quality",
    """WITH e AS (SELECT label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT label, v[1] AS x, v[2] AS y FROM e),
 c AS (SELECT label, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY 1), s AS (SELECT label, any_value(cx) AS cx, any_value(cy) AS cy, avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS w FROM p JOIN c USING (label) GROUP BY 1),
 r AS (SELECT a.label, max((a.w + b.w) / sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2)) AS worst FROM s a JOIN s b ON a.label <> b.label GROUP BY 1)
 SELECT 'labels' AS model, count(*) AS clusters, 0::BIGINT AS noise, round(avg(worst), 4) AS davies_bouldin FROM r""",
)
def cluster_quality(spark, sf):
    vectors = table(spark, sf, "embeddings").select(
        F.col("label").cast("long").alias("cluster"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y")
    )
    return rounded(clusters.cluster_quality(vectors, ["x", "y"], name="labels").drop("silhouette_sq"))


@query("compare_unsupervised")
def compare_unsupervised(spark, sf):
    points = _points(spark, sf).persist()
    names = ["value", "user_id"]

    @inheritable_thread_target(spark)
    def segments(k):
        return clusters.cluster_quality(clusters.kmeans_segments(points, names, k), names, name=f"KMeans ({k})")

    sizes = (2, 3, 4, 5)
    with ThreadPoolExecutor(len(sizes)) as pool:  # many short jobs of one model leave cores to the others
        waiting = [pool.submit(segments, k) for k in sizes]
        dense = clusters.cluster_quality(clusters.dbscan(points, names, "event_id"), names, name="DBSCAN")
        parts = [w.result() for w in waiting]
    parts.append(dense)
    odd = forest.isolation_forest(points, names, "event_id").agg(F.count(F.when(F.col("anomaly_score") < 0, 1)).alias("noise"))
    parts.append(odd.withColumn("model", F.lit("IsolationForest")))
    shares = clusters.pca_variance(points, names).agg(F.max("cumulative").alias("explained")).withColumn("model", F.lit("PCA (2 components)"))
    parts.append(shares)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return rounded(out)


# --- facts ------------------------------------------------------------------------

FEATURES = ["quantity", "lines", "discount", "tax"]
_SIGNAL = f"""sg AS (SELECT f, r FROM ({each(FEATURES, f"SELECT '{{c}}' AS f, corr({{c}}, revenue) AS r FROM ({MONTHS_SQL})")}) ORDER BY abs(r) DESC, f LIMIT 1)"""
_BEST = "bm AS (SELECT model || ' (r2=' || printf('%.3f', test_score) || ')' AS t FROM ms ORDER BY test_score DESC, model LIMIT 1)"


def _evaluation(spark, sf):
    return model_scores(spark, sf).select("model", F.col("test_score").alias("r2"))


@query(
    "executive_facts",
    f"""WITH m AS ({MONTHS_SQL}), {_SIGNAL}, {MODEL_SCORES}, {_BEST}
 SELECT 'dataset' AS section, 'rows' AS item, count(*)::VARCHAR AS value FROM m UNION ALL SELECT 'dataset', 'columns', '6'
 UNION ALL SELECT 'dataset', 'date_range', strftime(min(month), '%Y-%m-%d') || ' to ' || strftime(max(month), '%Y-%m-%d') FROM m
 UNION ALL SELECT 'dataset', 'target', 'revenue' UNION ALL SELECT 'findings', 'strongest_signal', f || ' (corr=' || printf('%.2f', r) || ')' FROM sg
 UNION ALL SELECT 'findings', 'best_model', t FROM bm""",
)
def executive_facts(spark, sf):
    return facts.executive_facts(months(spark, sf), "month", "revenue", _evaluation(spark, sf))


@query("report_facts")
def report_facts(spark, sf):
    return facts.report_facts(gappy_lines(spark, sf), "lineitem", LINE_KEY, "l_shipdate", "l_quantity", evaluation=_evaluation(spark, sf), template="Sales Analysis")


@query(
    "model_card_facts",
    f"""WITH {MODEL_SCORES}, {_BEST}, dr AS ({drift_sql('SELECT * FROM events', 'ts, event_id', ['value', 'user_id']).replace('WITH m AS', 'WITH mm AS').replace('FROM m)', 'FROM mm)')})
 SELECT 'model' AS section, 'target' AS item, 'l_extendedprice' AS value UNION ALL SELECT 'model', 'best_model', t FROM bm
 UNION ALL SELECT 'validation', 'failed_checks', '0' UNION ALL SELECT 'drift', 'drifting_features', count(*) FILTER (status <> 'Stable')::VARCHAR FROM dr""",
)
def model_card_facts(spark, sf):
    events = table(spark, sf, "events")
    validation = profile.validation_report(gappy_lines(spark, sf), "l_shipdate", "l_extendedprice")
    drift = profile.drift_report(events, "ts", ["value", "user_id"], ["event_id"])
    return facts.model_card_facts(_evaluation(spark, sf), "r2", validation, drift, "l_extendedprice")


@query(
    "conclusion_facts",
    f"""WITH s AS ({SEGMENTS_SQL}), r AS (SELECT corr(orders, revenue) AS o, corr(ticket, revenue) AS t FROM s), mo AS ({MONTHS_SQL}),
 f AS ({verdict_sql('mo', '')}), d AS (SELECT *, CASE WHEN last_value > first_value THEN 'Rise' WHEN last_value < first_value THEN 'Fall' ELSE 'Flat' END AS direction FROM f),
 v AS (SELECT *, {VERDICTS} FROM d)
 SELECT 'theory' AS section, 'supported' AS item, ((o > 0)::INT + (t > 0)::INT + (o < 0)::INT)::VARCHAR AS value FROM r
 UNION ALL SELECT 'theory', 'challenged', ((o <= 0)::INT + (t <= 0)::INT + (o >= 0)::INT)::VARCHAR FROM r
 UNION ALL SELECT 'periods', 'matched', count(*) FILTER (verdict = 'Matches real-life expectation')::VARCHAR FROM v
 UNION ALL SELECT 'periods', 'mixed', count(*) FILTER (verdict = 'Consistent with mixed real-world forces')::VARCHAR FROM v
 UNION ALL SELECT 'driver', CASE WHEN abs(o) >= abs(t) THEN 'orders' ELSE 'ticket' END, printf('%.2f', CASE WHEN abs(o) >= abs(t) THEN o ELSE t END) FROM r""",
)
def conclusion_facts(spark, sf):
    rows = segment_months(spark, sf)
    theory = correlation.theory_checks(rows, "revenue", ["orders", "ticket"], THEORIES)
    verdicts = series.period_verdicts(months(spark, sf), "month", "revenue", PERIODS)
    return facts.conclusion_facts(theory, verdicts, correlation.best_driver(rows, "revenue", ["orders", "ticket"]))


@query(
    "impact_facts",
    f"""WITH m AS (SELECT *, row_number() OVER (ORDER BY month DESC) AS rn FROM ({MONTHS_SQL})), {MODEL_SCORES}, {_BEST},
 d AS (SELECT max(revenue) FILTER (rn = 1) - max(revenue) FILTER (rn = 12) AS x FROM m)
 SELECT 'impact' AS section, 'best_model' AS item, t AS value FROM bm
 UNION ALL SELECT 'impact', 'movement', CASE WHEN x > 0 THEN 'positive ' WHEN x < 0 THEN 'negative ' ELSE 'flat ' END || printf('%.2f', x) FROM d""",
)
def impact_facts(spark, sf):
    return facts.impact_facts(_evaluation(spark, sf), "r2", series.latest_change(months(spark, sf), "month", "revenue"))


@query(
    "evaluation_gap",
    f"""WITH {MODEL_SCORES}, b AS (SELECT * FROM ms ORDER BY test_score DESC, model LIMIT 1), w AS (SELECT * FROM ms ORDER BY test_score, model LIMIT 1)
 SELECT b.model AS best_model, round(b.test_score, 6) AS best_score, w.model AS weakest_model, round(w.test_score, 6) AS weakest_score, round(b.test_score - w.test_score, 6) AS gap FROM b, w""",
)
def evaluation_gap(spark, sf):
    return rounded(facts.evaluation_gap(_evaluation(spark, sf), "r2"), 6)


@query(
    "context_summary",
    f"""WITH g AS ({GAPPY_SQL}), n AS ({each(COLS, "SELECT '{c}' AS c, count(*) - count({c}) AS k FROM g")})
 SELECT 'context' AS section, 'rows' AS item, count(*)::VARCHAR AS value FROM g UNION ALL SELECT 'context', 'columns', '12'
 UNION ALL SELECT 'context', 'date_range', strftime(min(l_shipdate), '%Y-%m-%d') || ' to ' || strftime(max(l_shipdate), '%Y-%m-%d') FROM g
 UNION ALL SELECT 'context', 'target', 'l_quantity' UNION ALL SELECT 'context', 'missing_cells', sum(k)::VARCHAR FROM n
 UNION ALL SELECT 'context', 'duplicate_rows', (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM g)))::VARCHAR FROM g
 UNION ALL SELECT * FROM (SELECT 'most_missing', c, k::VARCHAR FROM n ORDER BY k DESC, c LIMIT 5)""",
)
def context_summary(spark, sf):
    return facts.context_summary(gappy_lines(spark, sf), "l_shipdate", "l_quantity")
