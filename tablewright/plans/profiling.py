"""Profiling, schema intelligence and data quality."""

from pyspark.sql import functions as F

from tablewright.functions import labels
from tablewright.operators import profile
from tablewright.plans.inputs import GAPPY_SQL, LINE_KEY, LINE_ORDER, gappy_lines, months, MONTHS_SQL, period_sql, PERIODS
from tablewright.plans.registry import day, query, rounded, table
from tablewright.plans.tables import KINDS, each

COLS = list(KINDS)
NUMBERS = [c for c, k in KINDS.items() if k == "numeric"]
FACT = "coalesce({x}, 0)"
TURNS = "SELECT role, text FROM conversations"


def _gaps(cols):
    return " + ".join(f"count(*) - count({c})" for c in cols)


def _distinct_rows(source: str) -> str:
    return f"(SELECT count(*) FROM (SELECT DISTINCT * FROM ({source})))"


@query(
    "dataset_health",
    f"""WITH g AS (SELECT * EXCLUDE ({', '.join(LINE_KEY)}, l_extendedprice) FROM ({GAPPY_SQL}))
 SELECT count(*) AS rows, CAST(7 AS BIGINT) AS columns,
 CAST({_gaps([c for c in COLS if c not in LINE_KEY and c != 'l_extendedprice'])} AS BIGINT) AS missing_cells,
 count(*) - {_distinct_rows('SELECT * FROM g')} AS duplicate_rows, CAST(1 AS BIGINT) AS empty_columns FROM g""",
)
def dataset_health(spark, sf):
    return profile.dataset_health(gappy_lines(spark, sf).drop(*LINE_KEY, "l_extendedprice"))


@query(
    "missing_profile",
    f"WITH g AS ({GAPPY_SQL}) "
    + each(COLS, "SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0 / count(*), 4) AS missing_pct FROM g"),
)
def missing_profile(spark, sf):
    return rounded(profile.missing_profile(gappy_lines(spark, sf)))


@query("duplicate_count", f"SELECT count(*) - {_distinct_rows(TURNS)} AS duplicate_rows FROM conversations")
def duplicate_count(spark, sf):
    return profile.duplicate_count(table(spark, sf, "conversations").select("role", "text"))


PROFILED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "numeric_profile",
    f"WITH g AS ({GAPPY_SQL}) "
    + each(
        PROFILED,
        """SELECT '{c}' AS metric, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min,
 round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75,
 max({c}) AS max FROM g""",
    ),
)
def numeric_profile(spark, sf):
    return rounded(profile.numeric_profile(gappy_lines(spark, sf), PROFILED))


@query(
    "distinct_counts",
    each(
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
        "SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values FROM orders",
    ),
)
def distinct_counts(spark, sf):
    return profile.distinct_counts(table(spark, sf, "orders"))


_WORDS = ["l_returnflag", "l_linestatus", "l_shipdate"]


def _dictionary_row(c: str) -> str:
    role = "Date" if c == "l_shipdate" else "Default target" if c == "l_extendedprice" else "Feature"
    low, high = (f"min({c})::DOUBLE", f"max({c})::DOUBLE") if c in NUMBERS else ("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)")
    text = f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if c == "l_shipdate" else c
    examples = (
        f"(SELECT string_agg(t, ', ' ORDER BY k) FROM (SELECT {text} AS t, row_number() OVER (ORDER BY {', '.join(LINE_KEY)}) AS k "
        f"FROM g WHERE {c} IS NOT NULL QUALIFY k <= 3))"
        if c in _WORDS
        else "CAST(NULL AS VARCHAR)"
    )
    return (
        f"SELECT '{c}' AS column_name, '{role}' AS role, count(*) - count({c}) AS missing, "
        f"round((count(*) - count({c})) * 100.0 / count(*), 4) AS missing_pct, count(DISTINCT {c}) AS distinct_values, "
        f"{low} AS low, {high} AS high, {examples} AS examples FROM g"
    )


@query("data_dictionary", f"WITH g AS ({GAPPY_SQL}) " + " UNION ALL ".join(_dictionary_row(c) for c in COLS))
def data_dictionary(spark, sf):
    found = profile.data_dictionary(gappy_lines(spark, sf), LINE_KEY, "l_shipdate", "l_extendedprice")
    return rounded(found.drop("type"))


@query(
    "validation_report",
    f"""WITH g AS ({GAPPY_SQL}), f AS (SELECT count(*) AS n, count(*) - {_distinct_rows('SELECT * FROM g')} AS d,
 ({_gaps(COLS)}) * 100.0 / (count(*) * 12) AS m FROM g)
 SELECT 'Dataset has rows' AS check_name, 'Pass' AS status, n::VARCHAR AS value FROM f
 UNION ALL SELECT 'Duplicate rows', CASE WHEN d = 0 THEN 'Pass' ELSE 'Warning' END, d::VARCHAR FROM f
 UNION ALL SELECT 'Overall missing data', CASE WHEN m < 5 THEN 'Pass' WHEN m < 20 THEN 'Warning' ELSE 'Fail' END, printf('%.2f%%', m) FROM f
 UNION ALL SELECT 'Date column detected', 'Pass', 'l_shipdate'
 UNION ALL SELECT 'Target detected', 'Pass', 'l_extendedprice'
 UNION ALL SELECT 'Infinite numeric values', 'Pass', '0'""",
)
def validation_report(spark, sf):
    report = profile.validation_report(gappy_lines(spark, sf), "l_shipdate", "l_extendedprice")
    return profile.quality_gate(report)


DRIFT_SQL = """WITH m AS ({src}), o AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS rn, count(*) OVER () AS n FROM m),
 b AS (SELECT *, greatest(5, n // 3) AS k FROM o), f AS ({rows})
 SELECT metric, round(bm, 6) AS baseline_mean, round(cm, 6) AS current_mean, round((cm - bm) / abs(bm) * 100, 4) AS mean_shift_pct,
 round((cm - bm) / bs, 4) AS z_shift, CASE WHEN abs((cm - bm) / bs) >= 1.5 THEN 'High drift'
 WHEN abs((cm - bm) / bm * 100) >= 20 THEN 'Moderate drift' ELSE 'Stable' END AS status FROM f"""


def drift_sql(src: str, order: str, cols) -> str:
    rows = each(
        cols,
        """SELECT '{c}' AS metric, avg({c}) FILTER (rn < k) AS bm, avg({c}) FILTER (rn >= n - k) AS cm,
 stddev_samp({c}) FILTER (rn < k) AS bs FROM b""",
    )
    return DRIFT_SQL.format(src=src, order=order, rows=rows)


@query("drift_report", drift_sql("SELECT * FROM events", "ts, event_id", ["value", "user_id"]))
def drift_report(spark, sf):
    found = profile.drift_report(table(spark, sf, "events"), "ts", ["value", "user_id"], ["event_id"])
    return rounded(rounded(found, 4, ("baseline_mean", "current_mean")), 6)


TASKS = ["l_quantity", "l_linenumber", "l_tax", "l_extendedprice", "l_returnflag", "l_note", "l_missing"]


def _task_sql(c: str) -> str:
    if c == "l_missing":
        return "SELECT 'l_missing' AS target, 'Not ready' AS task"
    if c == "l_returnflag":
        return "SELECT 'l_returnflag' AS target, 'Classification' AS task"
    return (
        f"SELECT '{c}' AS target, CASE WHEN count({c}) = 0 THEN 'Not ready' WHEN count(DISTINCT {c}) <= "
        f"least(20, greatest(2, count({c}) // 10)) THEN 'Classification' ELSE 'Regression' END AS task FROM g"
    )


@query("infer_task_type", f"WITH g AS ({GAPPY_SQL}) " + " UNION ALL ".join(_task_sql(c) for c in TASKS))
def infer_task_type(spark, sf):
    return profile.infer_task_type(gappy_lines(spark, sf), TASKS)


_ORDERS = {"o_orderkey": True, "o_custkey": True, "o_orderstatus": False, "o_totalprice": False, "o_orderdate": False, "o_orderpriority": False}


@query(
    "identifier_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(count(DISTINCT {c}) / count({c}), 4) AS unique_share, "
        + (f"CASE WHEN count(DISTINCT {c}) / count({c}) > 0.95 THEN 1 ELSE 0 END::BIGINT" if whole else "0::BIGINT")
        + " AS is_identifier FROM orders"
        for c, whole in _ORDERS.items()
    )
    + " UNION ALL SELECT 'event_id', 1.0, 1::BIGINT",
)
def identifier_columns(spark, sf):
    orders = profile.identifier_columns(table(spark, sf, "orders"))
    events = profile.identifier_columns(table(spark, sf, "events")).filter("column_name = 'event_id'")
    return rounded(orders.unionByName(events))


@query(
    "date_candidates",
    """WITH r AS (SELECT count(*) AS n, count(TRY_CAST(o_orderstatus AS TIMESTAMP)) AS p1, count(DISTINCT o_orderdate) AS d,
 count(TRY_CAST(o_orderpriority AS TIMESTAMP)) AS p2 FROM orders)
 SELECT 'o_orderdate' AS column_name, round(25 + 45.0 + d / n * 10, 4) AS score, 100.0::DOUBLE AS parsed_pct, 'name + parseable dates' AS reason FROM r
 UNION ALL SELECT 'o_written', round(45.0 + d / n * 10, 4), 100.0, 'parseable dates' FROM r
 UNION ALL SELECT 'month', round(45.0 + 25, 4), 0.0, 'date-like name' FROM r""",
)
def date_candidates(spark, sf):
    orders = table(spark, sf, "orders").withColumns({"o_written": day("o_orderdate"), "month": F.month("o_orderdate").cast("double")})
    return rounded(profile.date_candidates(orders))


def _target_sql(c: str, words: int, whole: bool) -> str:
    unique = f"CASE WHEN count(DISTINCT {c}) / count({c}) > 0.95 THEN 45 ELSE 0 END" if whole else "0"
    room = "least(20, greatest(2, {n} // 10))"
    return (
        f"SELECT '{c}' AS column_name, round(count({c}) / count(*) * 35 + {words} + CASE WHEN count(DISTINCT {c}) BETWEEN 2 AND "
        f"{room.format(n='count(*)')} THEN 10 ELSE 18 END - {unique}, 4) AS score, round((1 - count({c}) / count(*)) * 100, 4) AS missing_pct, "
        f"count(DISTINCT {c}) AS distinct_values, CASE WHEN count(DISTINCT {c}) <= {room.format(n=f'count({c})')} THEN 'Classification' "
        f"ELSE 'Regression' END AS task FROM g"
    )


_TARGETS = {
    "l_orderkey": (0, True), "l_partkey": (0, True), "l_suppkey": (0, True), "l_linenumber": (0, True),
    "l_quantity": (65, False), "l_extendedprice": (30, False), "l_discount": (0, False), "l_tax": (0, False),
}


@query("target_candidates", f"WITH g AS ({GAPPY_SQL}) " + " UNION ALL ".join(_target_sql(c, *v) for c, v in _TARGETS.items()))
def target_candidates(spark, sf):
    return rounded(profile.target_candidates(gappy_lines(spark, sf), template="Sales Analysis"))


@query(
    "recommend_features",
    """SELECT feature, round(correlation, 6) AS correlation, row_number() OVER (ORDER BY abs(correlation) DESC, feature) AS rank FROM ("""
    + each(
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"],
        "SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS correlation FROM (" + GAPPY_SQL + ")",
    )
    + ")",
)
def recommend_features(spark, sf):
    return rounded(profile.recommend_features(gappy_lines(spark, sf), "l_extendedprice", "l_shipdate"), 6)


_LEAKY = {"revenue_lag1": 1, "revenue_smoothed": 1, "gross_revenue": 1, "quantity": 0, "discount": 0}


@query(
    "leaky_feature_rule",
    f"""WITH m AS ({MONTHS_SQL}), w AS (SELECT *, lag(revenue) OVER (ORDER BY month) AS revenue_lag1,
 avg(revenue) OVER (ORDER BY month ROWS 2 PRECEDING) AS revenue_smoothed, revenue + tax AS gross_revenue FROM m) """
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {flag}::BIGINT AS leaky, round(corr({c}, revenue), 6) AS correlation FROM w" for c, flag in _LEAKY.items()
    ),
)
def leaky_feature_rule(spark, sf):
    from tablewright.operators.ordinal import windowed

    def copies(w):
        return [{"revenue_lag1": F.lag("revenue").over(w), "revenue_smoothed": F.avg("revenue").over(w.rowsBetween(-2, 0)), "gross_revenue": F.col("revenue") + F.col("tax")}]

    wide = windowed(months(spark, sf), [], ["month"], copies, back=2)
    return rounded(profile.leaky_features(wide.select("revenue", *_LEAKY), "revenue"), 6)


@query(
    "find_date_col",
    "SELECT 'l_shipdate' AS column_name, strftime(min(l_shipdate), '%Y-%m-%d') AS first_day, strftime(max(l_shipdate), '%Y-%m-%d') AS last_day FROM lineitem",
)
def find_date_col(spark, sf):
    lines = table(spark, sf, "lineitem")
    name = labels.find_date_col(lines.columns)
    ends = lines.agg(F.min(name).alias("a"), F.max(name).alias("b"))
    return ends.select(F.lit(name).alias("column_name"), day("a").alias("first_day"), day("b").alias("last_day"))


_SETUP = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "smart_auto_setup",
    "WITH c AS ("
    + each(_SETUP, "SELECT '{c}' AS f, corr({c}, l_quantity) AS r FROM (" + GAPPY_SQL + ")")
    + """) SELECT 'source' AS item, 'lineitem' AS value
 UNION ALL SELECT 'recommended_date', 'l_shipdate' UNION ALL SELECT 'recommended_target', 'l_quantity'
 UNION ALL SELECT 'suggested_task', 'Regression' UNION ALL SELECT 'numeric_columns', '9' UNION ALL SELECT 'other_columns', '3'
 UNION ALL SELECT 'recommended_features', string_agg(f, ', ' ORDER BY abs(r) DESC, f) FROM c UNION ALL SELECT 'issues', 'none'""",
)
def smart_auto_setup(spark, sf):
    return profile.smart_setup(gappy_lines(spark, sf), "lineitem", "Sales Analysis")


@query(
    "project_profile",
    f"""WITH f AS (SELECT count(*) AS n, count(*) - {_distinct_rows('SELECT * FROM orders')} AS d, strftime(min(o_orderdate), '%Y-%m-%d') AS a,
 strftime(max(o_orderdate), '%Y-%m-%d') AS b FROM orders)
 SELECT 'project_name' AS item, 'Orders Extract' AS value UNION ALL SELECT 'source', 'file: orders_extract.parquet'
 UNION ALL SELECT 'mode', 'General data' UNION ALL SELECT 'rows', n::VARCHAR FROM f UNION ALL SELECT 'columns', '6'
 UNION ALL SELECT 'numeric_columns', '3' UNION ALL SELECT 'other_columns', '3' UNION ALL SELECT 'date_column', 'o_orderdate'
 UNION ALL SELECT 'date_range', a || ' to ' || b FROM f UNION ALL SELECT 'target', 'o_totalprice' UNION ALL SELECT 'task', 'Regression'
 UNION ALL SELECT 'missing_cells', '0' UNION ALL SELECT 'duplicate_rows', d::VARCHAR FROM f""",
)
def project_profile(spark, sf):
    return profile.project_profile(table(spark, sf, "orders"), "file: orders_extract.parquet", "o_orderdate", "o_totalprice")


@query(
    "scale_readiness",
    """SELECT 'Volume' AS dimension, count(*)::VARCHAR || ' rows, 11 columns' AS evidence,
 CASE WHEN count(*) >= 5000000 THEN 'Large' WHEN count(*) >= 100000 THEN 'Medium' ELSE 'Small' END AS readiness FROM lineitem
 UNION ALL SELECT 'Variety', '8 numeric measures', 'Structured data'
 UNION ALL SELECT 'Time partitioning', count(DISTINCT year(l_shipdate))::VARCHAR || ' years', 'Ready' FROM lineitem""",
)
def scale_readiness(spark, sf):
    return profile.scale_readiness(table(spark, sf, "lineitem"), "l_shipdate")


@query(
    "stage_status",
    """SELECT 'Raw data' AS stage, 'Complete' AS status, count(*)::VARCHAR AS output FROM lineitem
 UNION ALL SELECT 'Cleaning', 'Complete', 'l_shipdate' UNION ALL SELECT 'Feature selection', 'Complete', 'l_quantity'
 UNION ALL SELECT 'Model training', 'Run Evaluation', 'No run yet' UNION ALL SELECT 'Evaluation', 'Run Evaluation', 'No metrics yet'
 UNION ALL SELECT 'Reporting', 'Complete', 'Report facts'""",
)
def stage_status(spark, sf):
    return profile.stage_status(table(spark, sf, "lineitem"), "l_shipdate", "l_quantity")


def _search_sql(words) -> str:
    parts = []
    for w in words:
        near = f"len(list_filter(list_filter(string_split_regex(e, '\\s+'), lambda x: x <> ''), lambda x: 1.0 - levenshtein(x, '{w}') / greatest(length(x), {len(w)}) >= 0.78)) > 0"
        parts.append(f"CASE WHEN contains(t, '{w}') THEN 5.0 WHEN contains(k, '{w}') THEN 3.0 WHEN contains(d, '{w}') THEN 2.0 WHEN {near} THEN 1.5 ELSE 0.0 END")
    return " + ".join(parts)


@query(
    "catalog_search",
    f"""WITH x AS (SELECT p_partkey, p_name, lower(p_name) AS t, lower(p_type) AS k, lower(p_brand) AS d, lower(p_name || ' ' || p_type || ' ' || p_brand) AS e FROM part)
 SELECT p_partkey, p_name, (score)::DOUBLE AS score FROM (SELECT *, CASE WHEN contains(t, 'red widgit promo') THEN 8.0 ELSE 0.0 END
 + CASE WHEN contains(e, 'red widgit promo') THEN 4.0 ELSE 0.0 END + {_search_sql(['red', 'widgit', 'promo'])} AS score FROM x)
 WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 25""",
)
def catalog_search(spark, sf):
    return profile.catalog_search(table(spark, sf, "part"), "Red widgit promo", "p_name", "p_type", "p_brand", "p_partkey", 25)


@query(
    "box_stats",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75
 FROM events GROUP BY 1), f AS (SELECT *, q25 - 1.5 * (q75 - q25) AS lo, q75 + 1.5 * (q75 - q25) AS hi FROM q)
 SELECT event_type, round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75, round(lo, 4) AS low_fence, round(hi, 4) AS high_fence,
 count(*) AS n, min(value) FILTER (value BETWEEN lo AND hi) AS low_whisker, max(value) FILTER (value BETWEEN lo AND hi) AS high_whisker,
 count(*) FILTER (value NOT BETWEEN lo AND hi) AS outliers FROM events JOIN f USING (event_type) GROUP BY ALL""",
)
def box_stats(spark, sf):
    return rounded(profile.box_stats(table(spark, sf, "events"), "value", ["event_type"]))


@query(
    "box_points",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75 FROM events GROUP BY 1),
 f AS (SELECT event_type, q25 - 1.5 * (q75 - q25) AS lo, q75 + 1.5 * (q75 - q25) AS hi FROM q)
 SELECT event_id, event_type, value, CASE WHEN value < lo THEN 'low' ELSE 'high' END AS side FROM events JOIN f USING (event_type)
 WHERE value < lo OR value > hi""",
)
def box_points(spark, sf):
    return profile.box_points(table(spark, sf, "events").select("event_id", "event_type", "value"), "value", ["event_type"])


@query(
    "histogram",
    f"""WITH b AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 35 AS w FROM lineitem)
 SELECT {period_sql('l_shipdate')} AS time_group, least(floor((l_extendedprice - lo) / w)::BIGINT + 1, 35) AS bin, count(*) AS n,
 round(any_value(lo + (least(floor((l_extendedprice - lo) / w)::BIGINT + 1, 35) - 1) * w), 4) AS bin_start FROM lineitem, b GROUP BY 1, 2""",
)
def histogram(spark, sf):
    named = table(spark, sf, "lineitem").withColumn("time_group", labels.period_label(F.col("l_shipdate"), PERIODS))
    return rounded(profile.histogram(named, "l_extendedprice", 35, ["time_group"]))
