"""Cleaning and repair."""

from pyspark.sql import functions as F

from tablewright.operators import cleaning
from tablewright.plans.inputs import (
    GAPPY_SQL,
    LINE_KEY,
    MONTHS_SQL,
    PERIODS,
    SPIKY_SQL,
    gappy_lines,
    months,
    period_sql,
    spiky_events,
)
from tablewright.plans.registry import day, query, rounded, table
from tablewright.plans.tables import each

PRICE = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice"}


@query("trim_columns", 'SELECT s_suppkey, s_name, s_acctbal FROM supplier')
def trim_columns(spark, sf):
    padded = table(spark, sf, "supplier").select(F.col("s_suppkey").alias(" s_suppkey"), F.col("s_name").alias("s_name "), "s_acctbal")
    return cleaning.trim_columns(padded)


@query(
    "parse_date",
    """SELECT o_orderkey, strftime(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END, '%Y-%m-%d') AS placed FROM orders""",
)
def parse_date(spark, sf):
    orders = table(spark, sf, "orders")
    written = F.when(F.col("o_orderstatus") == "P", F.lit("2020-13-01")).otherwise(day("o_orderdate"))
    parsed = cleaning.parse_date_column(orders.withColumn("placed", written), "placed")
    return parsed.select("o_orderkey", day("placed").alias("placed"))


@query(
    "coerce_numeric",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS reading, event_type FROM events""",
)
def coerce_numeric(spark, sf):
    events = table(spark, sf, "events")
    written = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    return cleaning.coerce_numeric(events.select("event_id", written.alias("reading"), "event_type"))


@query(
    "clean_data",
    f"""SELECT o_orderkey, o_totalprice, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
 {period_sql('o_orderdate')} AS time_group FROM orders""",
)
def clean_data(spark, sf):
    orders = table(spark, sf, "orders")
    raw = orders.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey "),
        F.col("o_totalprice").cast("string").alias(" o_totalprice"),
        "o_orderpriority",
        day("o_orderdate").alias("o_orderdate"),
    )
    cleaned, date = cleaning.clean_table(raw, PERIODS)
    return cleaned.withColumn("o_orderkey", F.col("o_orderkey").cast("long")).withColumn(date, day(date))


@query("drop_columns", "SELECT * EXCLUDE (l_shipdate, l_returnflag, l_linestatus) FROM lineitem")
def drop_columns(spark, sf):
    return cleaning.drop_columns(table(spark, sf, "lineitem"), ["l_shipdate", "l_returnflag", "l_linestatus", "l_absent"])


@query("drop_empty_columns", f"SELECT * EXCLUDE (l_note, l_shipdate) FROM ({GAPPY_SQL})")
def drop_empty_columns(spark, sf):
    return cleaning.drop_empty_columns(gappy_lines(spark, sf).drop("l_shipdate"))


@query("drop_duplicates", "SELECT DISTINCT role, text FROM conversations")
def drop_duplicates(spark, sf):
    return cleaning.drop_duplicates(table(spark, sf, "conversations").select("role", "text"))


@query(
    "drop_duplicates_first",
    "SELECT doc_id, text, lang, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
)
def drop_duplicates_first(spark, sf):
    return cleaning.drop_duplicates(table(spark, sf, "documents"), ["text"], ["doc_id"])


_FILL = f"""WITH g AS ({GAPPY_SQL}), f AS (SELECT {{how}}(l_discount) AS d, {{how}}(l_tax) AS t FROM g)
 SELECT {', '.join(LINE_KEY)}, round(coalesce(l_discount, d), 6) AS l_discount, round(coalesce(l_tax, t), 6) AS l_tax FROM g, f"""


@query("fill_numeric", _FILL.format(how="median"))
def fill_numeric(spark, sf):
    done = cleaning.fill_numeric(gappy_lines(spark, sf), ["l_discount", "l_tax", "l_note"], "median")
    return rounded(done.select(*LINE_KEY, "l_discount", "l_tax"), 6)


@query("fill_numeric_mean", _FILL.format(how="avg"))
def fill_numeric_mean(spark, sf):
    done = cleaning.fill_numeric(gappy_lines(spark, sf), ["l_discount", "l_tax"], "mean")
    return rounded(done.select(*LINE_KEY, "l_discount", "l_tax"), 6)


@query(
    "fill_mode",
    f"""WITH g AS ({GAPPY_SQL}), m AS (SELECT l_returnflag AS flag FROM g WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
 SELECT {', '.join(LINE_KEY)}, coalesce(l_returnflag, flag) AS l_returnflag FROM g, m""",
)
def fill_mode(spark, sf):
    return cleaning.fill_mode(gappy_lines(spark, sf), ["l_returnflag"]).select(*LINE_KEY, "l_returnflag")


@query(
    "fill_from_correlated",
    f"""WITH s AS ({SPIKY_SQL}), p AS (SELECT event_id, user_id, value, value * 2 + user_id AS gauge FROM ({SPIKY_SQL.replace("CASE WHEN event_type <> 'view' THEN value END", 'value')})),
 g AS (SELECT p.event_id, s.value, p.gauge FROM p JOIN s USING (event_id)),
 f AS (SELECT regr_slope(value, gauge) AS a, regr_intercept(value, gauge) AS b FROM g)
 SELECT event_id, round(coalesce(value, b + a * gauge), 4) AS value FROM g, f""",
)
def fill_from_correlated(spark, sf):
    gauged = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") != "view", F.col("value")).alias("value"),
        (F.col("value") * 2 + F.col("user_id")).alias("gauge"),
    )
    done, _ = cleaning.fill_from_correlated(gauged, ["value"], max_features=1)
    return rounded(done.select("event_id", "value"))


_FENCE = """WITH s AS (SELECT * FROM events), q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM s),
 f AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q) """


@query("iqr_flags", _FENCE + "SELECT event_id, value, (value < lo OR value > hi)::BIGINT AS value_outlier FROM s, f")
def iqr_flags(spark, sf):
    flagged = cleaning.iqr_flags(table(spark, sf, "events"), ["value"])
    return flagged.select("event_id", "value", F.col("value_outlier").cast("int").cast("long").alias("value_outlier"))


@query("remove_iqr_outliers", _FENCE + "SELECT event_id, value FROM s, f WHERE value BETWEEN lo AND hi")
def remove_iqr_outliers(spark, sf):
    return cleaning.remove_iqr_outliers(table(spark, sf, "events"), ["value"]).select("event_id", "value")


@query("cap_iqr_outliers", _FENCE + "SELECT event_id, round(least(greatest(value, lo), hi), 4) AS value FROM s, f")
def cap_iqr_outliers(spark, sf):
    return rounded(cleaning.cap_iqr_outliers(table(spark, sf, "events"), ["value"]).select("event_id", "value"))


@query(
    "replace_outliers",
    _FENCE
    + """, m AS (SELECT median(value) AS v FROM s, f WHERE value BETWEEN lo AND hi)
 SELECT event_id, round(CASE WHEN value < lo OR value > hi THEN v ELSE value END, 4) AS value FROM s, f, m""",
)
def replace_outliers(spark, sf):
    return rounded(cleaning.replace_outliers(table(spark, sf, "events"), ["value"], "median").select("event_id", "value"))


@query("estimate_outliers")
def estimate_outliers(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "value", F.length("props").alias("props_chars"))
    done, _ = cleaning.estimate_outliers(events, ["value"])
    return done.select("event_id", "value")


@query(
    "cleaning_studio",
    f"""WITH d AS (SELECT DISTINCT user_id, event_type, value, CASE WHEN event_type <> 'view' THEN ts::DATE END AS day FROM ({SPIKY_SQL})),
 m AS (SELECT median(value) AS v FROM d), x AS (SELECT day FROM d WHERE day IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
 n AS (SELECT user_id, event_type, coalesce(value, v) AS value FROM d, m),
 q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM n)
 SELECT 'Drop selected columns' AS action, 0::BIGINT AS cells_changed, 0::BIGINT AS rows_changed, -1::BIGINT AS columns_changed
 UNION ALL SELECT 'Drop empty columns', 0, 0, -1
 UNION ALL SELECT 'Remove duplicate rows', 0, (SELECT count(*) FROM d) - (SELECT count(*) FROM events), 0
 UNION ALL SELECT 'Repair numeric missing values', (SELECT count(*) FROM d WHERE value IS NULL), 0, 0
 UNION ALL SELECT 'Fill categorical missing values', (SELECT count(*) FROM d WHERE day IS NULL), 0, 0
 UNION ALL SELECT 'Repair numeric outliers', (SELECT count(*) FROM n, q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)), 0, 0""",
)
def cleaning_studio(spark, sf):
    events = spiky_events(spark, sf).select(
        "user_id",
        "event_type",
        "value",
        F.when(F.col("event_type") != "view", F.col("ts").cast("date")).alias("day"),
        "props",
        F.lit(None).cast("double").alias("note"),
    )
    plan = cleaning.StudioPlan(
        drop=["props"], drop_empty=True, drop_repeats=True, numeric_columns=["value"], numeric_fill="median",
        fill_text=True, outlier_columns=["value"], outliers="cap",
    )
    return cleaning.cleaning_studio(events, plan)[1]


@query(
    "cleaning_report",
    """WITH r AS (SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS bad,
 count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, CASE WHEN event_type <> 'error' THEN value END FROM events)) AS d FROM events)
 SELECT 'Column names' AS step, '1' AS result, 'Applied' AS status UNION ALL SELECT 'Date parsing', 'none', 'Checked - not available'
 UNION ALL SELECT 'Numeric conversion', '2', 'Applied'
 UNION ALL SELECT 'Missing values', '0 -> ' || bad::VARCHAR, CASE WHEN bad = 0 THEN 'Checked - already clean' ELSE 'Needs attention' END FROM r
 UNION ALL SELECT 'Duplicate rows', d::VARCHAR, CASE WHEN d = 0 THEN 'Checked - already clean' ELSE 'Needs attention' END FROM r
 UNION ALL SELECT 'Period label', 'time_group', 'Applied'
 UNION ALL SELECT 'Row count', n::VARCHAR || ' -> ' || n::VARCHAR, 'Checked - already clean' FROM r""",
)
def cleaning_report(spark, sf):
    events = table(spark, sf, "events")
    written = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    raw = events.select(F.col("user_id").alias("user_id "), written.alias("reading"))
    cleaned, date = cleaning.clean_table(raw)
    return cleaning.cleaning_report(raw, cleaned, date)


@query(
    "forward_fill",
    f"""WITH s AS ({SPIKY_SQL}) SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS value,
 last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id) AS any_value FROM s""",
)
def forward_fill(spark, sf):
    events = spiky_events(spark, sf).select("event_id", "ts", "event_type", "value", F.col("value").alias("any_value"))
    keyed = cleaning.forward_fill(events, ["value"], ["event_type"], ["ts", "event_id"])
    return cleaning.forward_fill(keyed, ["any_value"], [], ["ts", "event_id"]).select("event_id", "value", "any_value")


@query(
    "inf_to_null",
    f"""WITH m AS ({MONTHS_SQL}), c AS (SELECT month, revenue, lag(revenue) OVER (ORDER BY month) AS before FROM m)
 SELECT strftime(month, '%Y-%m-%d') AS month, round(ln(revenue), 6) AS size, CAST(NULL AS DOUBLE) AS broken FROM c""",
)
def inf_to_null(spark, sf):
    wild = months(spark, sf).select(day("month").alias("month"), F.log("revenue").alias("size"), (F.col("revenue") * F.lit(float("inf"))).alias("broken"))
    return rounded(cleaning.inf_to_null(wild), 6)
