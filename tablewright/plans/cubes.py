"""Grouped summaries, pivots, cubes and correlations."""

from pyspark.sql import functions as F

from tablewright.functions import labels
from tablewright.operators import correlation, olap
from tablewright.plans.inputs import GAPPY_SQL, LINE_ORDER, MONTHS_SQL, PERIODS, SEGMENTS_SQL, gappy_lines, months, period_sql, segment_months
from tablewright.plans.registry import query, rounded, table
from tablewright.plans.tables import each

MEASURES = ["revenue", "quantity", "discount"]


def _labelled(spark, sf):
    return months(spark, sf).withColumn("time_group", labels.period_label(F.col("month"), PERIODS))


_LABELLED = f"WITH m AS (SELECT *, {period_sql('month')} AS time_group FROM ({MONTHS_SQL})) "


@query(
    "period_compare",
    _LABELLED
    + each(
        MEASURES,
        """SELECT time_group, '{c}' AS metric, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
 round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(median({c}), 4) AS median FROM m GROUP BY 1""",
    ),
)
def period_compare(spark, sf):
    return rounded(olap.period_compare(_labelled(spark, sf), "time_group", MEASURES))


@query("period_means_long", _LABELLED + each(MEASURES, "SELECT time_group, '{c}' AS metric, round(avg({c}), 4) AS mean FROM m GROUP BY 1"))
def period_means_long(spark, sf):
    return rounded(olap.period_means(_labelled(spark, sf), "time_group", MEASURES))


_YEARS = list(range(1995, 2002))


def _wide(flags: str, how: str) -> str:
    cells = ", ".join(
        f"round(coalesce({how} FILTER (year(l_shipdate) = {y}), 0), 4)::DOUBLE AS \"l_quantity | {y}\"" for y in _YEARS
    )
    return f"SELECT {flags}, {cells} FROM "


@query(
    "olap_pivot",
    f"""WITH g AS ({GAPPY_SQL}), k AS (SELECT DISTINCT l_returnflag FROM g), s AS (SELECT DISTINCT l_linestatus FROM g),
 z AS (SELECT k.l_returnflag, s.l_linestatus, g.l_quantity, g.l_shipdate FROM k CROSS JOIN s LEFT JOIN g
 ON g.l_returnflag IS NOT DISTINCT FROM k.l_returnflag AND g.l_linestatus IS NOT DISTINCT FROM s.l_linestatus)
 """
    + _wide("coalesce(l_returnflag, '-') AS l_returnflag, l_linestatus", "avg(l_quantity)")
    + "z GROUP BY 1, 2",
)
def olap_pivot(spark, sf):
    years = gappy_lines(spark, sf).withColumn("year", F.year("l_shipdate"))
    wide = olap.olap_pivot(years, ["l_returnflag", "l_linestatus"], "year", _YEARS, "l_quantity", "mean")
    return rounded(wide.fillna("-", subset=["l_returnflag"]))


@query("flatten_pivot", _wide("l_linestatus", "sum(l_quantity)") + "lineitem GROUP BY 1")
def flatten_pivot(spark, sf):
    years = table(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate"))
    return olap.olap_pivot(years, ["l_linestatus"], "year", _YEARS, "l_quantity", "sum")


_CELLS = """WITH c AS (SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS v FROM lineitem GROUP BY 1, 2),
 n AS (SELECT concat_ws(' / ', 'l_returnflag: ' || l_returnflag, 'l_linestatus: ' || l_linestatus) AS segment, v FROM c) """


def _cells(spark, sf):
    return rounded(olap.olap_cells(table(spark, sf, "lineitem"), ["l_returnflag"], ["l_linestatus"], ["l_extendedprice"]))


@query(
    "olap_insight",
    _CELLS
    + """, t AS (SELECT * FROM n ORDER BY v DESC, segment LIMIT 1), b AS (SELECT * FROM n ORDER BY v, segment LIMIT 1)
 SELECT t.segment AS top_segment, t.v AS top_value, b.segment AS bottom_segment, b.v AS bottom_value, round(t.v - b.v, 4) AS spread,
 round((t.v - b.v) * 100 / abs(b.v), 4) AS gap_pct, (SELECT count(*) FROM n) AS segments FROM t, b""",
)
def olap_insight(spark, sf):
    return rounded(olap.olap_insight(_cells(spark, sf), ["l_returnflag", "l_linestatus"], "l_extendedprice"))


@query("top_segments", _CELLS + "SELECT segment, v AS value FROM n ORDER BY v DESC, segment LIMIT 5")
def top_segments(spark, sf):
    return olap.top_segments(_cells(spark, sf), ["l_returnflag", "l_linestatus"], "l_extendedprice")


_CUBE = """SELECT l_returnflag, l_linestatus, l_linenumber::BIGINT AS l_linenumber, sum(l_quantity) AS value FROM lineitem
 GROUP BY 1, 2, 3 ORDER BY value DESC, 1, 2, 3 LIMIT 30"""


def _cube(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    return olap.cube_cells(lines, ["l_returnflag", "l_linestatus", "l_linenumber"], "l_quantity", "sum", 30)


@query("cube_cells", _CUBE)
def cube_cells(spark, sf):
    return _cube(spark, sf)


@query("cube_face", f"SELECT l_returnflag, l_linestatus, round(avg(value), 4) AS value FROM ({_CUBE}) GROUP BY 1, 2")
def cube_face(spark, sf):
    return rounded(olap.cube_face(_cube(spark, sf), "l_returnflag", "l_linestatus"))


@query(
    "dimension_codes",
    "SELECT p_brand, n, row_number() OVER (ORDER BY k) - 1 AS code FROM (SELECT p_brand, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY 1)",
)
def dimension_codes(spark, sf):
    return olap.dimension_codes(table(spark, sf, "part"), "p_brand", ["p_partkey"])


@query(
    "date_dimensions",
    "SELECT year(l_shipdate)::VARCHAR AS olap_year, 'Q' || quarter(l_shipdate)::VARCHAR AS olap_quarter, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2",
)
def date_dimensions(spark, sf):
    named = olap.date_dimensions(table(spark, sf, "lineitem"), "l_shipdate")
    return named.groupBy("olap_year", "olap_quarter").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


_LEVELS = """SELECT l_returnflag, l_linestatus, (GROUPING(l_returnflag) * 2 + GROUPING(l_linestatus))::BIGINT AS level,
 sum(l_quantity) AS value, count(*) AS n FROM lineitem GROUP BY {kind}(l_returnflag, l_linestatus)"""


@query("rollup_cube", _LEVELS.format(kind="ROLLUP"))
def rollup_cube(spark, sf):
    return olap.rollup_cube(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


@query("full_cube", _LEVELS.format(kind="CUBE"))
def full_cube(spark, sf):
    return olap.rollup_cube(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", every=True)


_ORDERED = [p[0] for p in PERIODS]


@query(
    "named_agg_summary",
    _LABELLED
    + ", w(position, time_group) AS (VALUES "
    + ", ".join(f"({i}::BIGINT, '{p}')" for i, p in enumerate(_ORDERED))
    + """) SELECT position, time_group, round(avg(revenue), 4) AS avg_revenue, round(avg(tax), 6) AS avg_tax FROM w LEFT JOIN m USING (time_group) GROUP BY 1, 2""",
)
def named_agg_summary(spark, sf):
    found = olap.named_summary(_labelled(spark, sf), "time_group", _ORDERED, {"avg_revenue": "revenue", "avg_tax": "tax"})
    return rounded(rounded(found, 4, ("avg_tax",)), 6)


@query(
    "normalized_profile",
    _LABELLED
    + """, e AS (SELECT min(revenue) AS a, max(revenue) AS b, min(discount) AS c, max(discount) AS d FROM m)
 SELECT time_group, 'revenue' AS metric, round(avg((revenue - a) / (b - a)), 6) AS value FROM m, e WHERE time_group IN ('Opening years', 'Build-up') GROUP BY 1
 UNION ALL SELECT time_group, 'discount', round(avg((discount - c) / (d - c)), 6) FROM m, e WHERE time_group IN ('Opening years', 'Build-up') GROUP BY 1""",
)
def normalized_profile(spark, sf):
    return rounded(olap.normalized_profile(_labelled(spark, sf), "time_group", "month", ["revenue", "discount"]), 6)


@query("value_counts", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def value_counts(spark, sf):
    return olap.value_counts(table(spark, sf, "documents"), "source")


@query(
    "ols_trend",
    f"""SELECT {period_sql('l_shipdate')} AS time_group, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
 round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1""",
)
def ols_trend(spark, sf):
    named = table(spark, sf, "lineitem").withColumn("time_group", labels.period_label(F.col("l_shipdate"), PERIODS))
    return rounded(rounded(olap.ols_trend(named, "l_extendedprice", "l_quantity", ["time_group"]), 4, ("r2",)), 6)


MATRIX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_note"]


def _pair(a: str, b: str, source: str, extra: str = "") -> str:
    value = "CAST(NULL AS DOUBLE)" if "l_note" in (a, b) else "1.0::DOUBLE" if a == b else f"round(corr({a}, {b}), 6)"
    return f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {value} AS correlation{extra} FROM {source}" + (" LIMIT 1" if a == b or "l_note" in (a, b) else "")


@query("corr_matrix", f"WITH g AS ({GAPPY_SQL}) " + " UNION ALL ".join(f"({_pair(a, b, 'g')})" for a in MATRIX for b in MATRIX))
def corr_matrix(spark, sf):
    return rounded(correlation.corr_matrix(gappy_lines(spark, sf), MATRIX), 6)


_DRIVERS = ["quantity", "lines", "discount", "tax"]
_FOUND = f"WITH m AS ({MONTHS_SQL}), c AS (" + each(_DRIVERS, "SELECT '{c}' AS feature, corr({c}, revenue) AS r FROM m") + ") "


@query(
    "top_correlations",
    _FOUND
    + """SELECT feature, round(r, 6) AS correlation, CASE WHEN r > 0 THEN 'Moves with target' ELSE 'Moves against target' END AS reading,
 row_number() OVER (ORDER BY abs(r) DESC, feature) AS rank FROM c""",
)
def top_correlations(spark, sf):
    return rounded(correlation.top_correlations(months(spark, sf), "revenue", _DRIVERS), 6)


_ALL = ["revenue", *_DRIVERS]


@query(
    "correlation_summary",
    f"WITH m AS ({MONTHS_SQL}), p AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", corr({a}, {b}) AS r FROM m" for i, a in enumerate(_ALL) for b in _ALL[i + 1 :])
    + """) SELECT * FROM (SELECT 'target_positive' AS section, "left", "right", round(r, 6) AS correlation FROM p WHERE "left" = 'revenue' ORDER BY r DESC LIMIT 1)
 UNION ALL SELECT * FROM (SELECT 'target_negative', "left", "right", round(r, 6) FROM p WHERE "left" = 'revenue' ORDER BY r LIMIT 1)
 UNION ALL SELECT * FROM (SELECT 'pair', "left", "right", round(r, 6) FROM p ORDER BY abs(r) DESC LIMIT 10)""",
)
def correlation_summary(spark, sf):
    return rounded(correlation.correlation_summary(months(spark, sf), "revenue", _DRIVERS), 6)


@query("best_driver", _FOUND + "SELECT feature, round(r, 6) AS correlation FROM c ORDER BY abs(r) DESC, feature LIMIT 1")
def best_driver(spark, sf):
    return rounded(correlation.best_driver(months(spark, sf), "revenue", _DRIVERS), 6)


THEORIES = [
    ("More orders lift revenue", "Positive", [("orders",)]),
    ("Larger tickets lift revenue", "Positive", [("basket",), ("ticket",)]),
    ("Orders shrink tickets", "Negative", [("orders",)]),
    ("Income supports demand", "Positive", [("income",)]),
]


@query(
    "theory_checks",
    f"""WITH s AS ({SEGMENTS_SQL}), r AS (SELECT corr(orders, revenue) AS o, corr(ticket, revenue) AS t FROM s)
 SELECT 'More orders lift revenue' AS theory, 'Positive' AS expected_sign, 'orders' AS feature, round(o, 6) AS correlation,
 CASE WHEN o > 0 THEN 'Supports theory' ELSE 'Challenges theory' END AS evidence FROM r
 UNION ALL SELECT 'Larger tickets lift revenue', 'Positive', 'ticket', round(t, 6), CASE WHEN t > 0 THEN 'Supports theory' ELSE 'Challenges theory' END FROM r
 UNION ALL SELECT 'Orders shrink tickets', 'Negative', 'orders', round(o, 6), CASE WHEN o < 0 THEN 'Supports theory' ELSE 'Challenges theory' END FROM r
 UNION ALL SELECT 'Income supports demand', 'Positive', 'none', NULL, 'Missing feature'""",
)
def theory_checks(spark, sf):
    return rounded(correlation.theory_checks(segment_months(spark, sf), "revenue", ["orders", "ticket"], THEORIES), 6)
