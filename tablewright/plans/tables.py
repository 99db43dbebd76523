"""Scans, sinks, projections and filters."""

from pyspark.sql import functions as F

from tablewright.functions import labels
from tablewright.operators import cleaning, marts, reshape
from tablewright.plans.inputs import GAPPY_SQL, LINE_KEY, LINE_ORDER, PERIODS, gappy_lines, period_sql
from tablewright.plans.registry import day, query, rounded, table
from tablewright.session import scratch_path
from tablewright.sources import sinks, tables

ORDER_SCHEMA = (
    "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string"
)


@query(
    "csv_scan",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
 o_orderpriority FROM orders""",
)
def csv_scan(spark, sf):
    path = sinks.write_csv(table(spark, sf, "orders"), scratch_path(spark, "orders-csv"))
    return tables.read_csv(spark, path, ORDER_SCHEMA).withColumn("o_orderdate", day("o_orderdate"))


@query("resolve_dataset", "SELECT count(*) AS n, max(o_orderkey) AS last_key FROM orders")
def resolve_dataset(spark, sf):
    root = sf.rstrip("/")
    found = tables.resolve_dataset(spark, [tables.layer_path(root, "01_raw", "orders.parquet"), f"{root}/orders.parquet"])
    return spark.read.parquet(found).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_key"))


@query(
    "prepare_dataset",
    f"""SELECT {period_sql('o_orderdate')} AS time_group, o_orderstatus, count(*) AS n,
 round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2""",
)
def prepare_dataset(spark, sf):
    orders = table(spark, sf, "orders")
    raw = orders.select(*[F.col(c).cast("string").alias(f" {c} ") for c in orders.columns])
    cleaned, _, _ = tables.prepare_dataset(raw, scratch_path(spark, "prepared"), PERIODS)
    return rounded(cleaned.groupBy("time_group", "o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 2)


SUMMARY_SQL = """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2"""


def _summary(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")
    )


@query("csv_sink", SUMMARY_SQL)
def csv_sink(spark, sf):
    path = sinks.write_csv(_summary(spark, sf), scratch_path(spark, "summary-csv"))
    return tables.read_csv(spark, path, "l_returnflag string, l_linestatus string, n long, quantity double")


@query("mart_publish", SUMMARY_SQL)
def mart_publish(spark, sf):
    return spark.read.parquet(sinks.publish_mart(_summary(spark, sf), scratch_path(spark, "marts"), "flag_status"))


@query(
    "growing_mart",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, count(l_extendedprice) AS l_extendedprice_n, round(sum(l_extendedprice), 2) AS l_extendedprice_sum,
 round(avg(l_extendedprice), 4) AS l_extendedprice_mean, round(stddev_samp(l_extendedprice), 4) AS l_extendedprice_std,
 min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max FROM lineitem GROUP BY 1, 2""",
)
def growing_mart(spark, sf):
    """Published up to a month, then grown by the months that came after it."""
    price = F.col("l_extendedprice").cast("double").alias("l_extendedprice")
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", price, F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    mart = marts.Mart(scratch_path(spark, "growing"), "month", ["l_returnflag", "l_linestatus"], ["l_extendedprice"])
    marts.refresh(lines.filter("month <= '1997-06'"), mart)
    marts.refresh(lines, mart)
    made = marts.merged(spark, mart, mart.partials(lines).schema)
    rounding = {"sum": 2, "mean": 4, "std": 4}
    return made.withColumns({f"l_extendedprice_{c}": F.round(f"l_extendedprice_{c}", d) for c, d in rounding.items()})


@query(
    "partitioned_parquet",
    """SELECT year(l_shipdate) AS year, month(l_shipdate) AS month, count(*) AS n, sum(l_quantity) AS quantity
 FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-03-01' AND l_shipdate < TIMESTAMP '1997-03-01' GROUP BY 1, 2""",
)
def partitioned_parquet(spark, sf):
    path = sinks.write_by_month(table(spark, sf, "lineitem"), "l_shipdate", scratch_path(spark, "lines-by-month"))
    window = sinks.read_months(spark, path, (1996, 3), (1997, 2))
    return window.groupBy(F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month")).agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")
    )


@query(
    "year_partition_counts",
    "SELECT year(l_shipdate) AS year, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 1 DESC NULLS FIRST LIMIT 12",
)
def year_partition_counts(spark, sf):
    counted = tables.year_partition_counts(table(spark, sf, "lineitem"), "l_shipdate")
    return counted.withColumn("year", F.col("year").cast("long"))


@query("raw_preview", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_custkey LIMIT 200")
def raw_preview(spark, sf):
    return tables.raw_preview(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), ["c_custkey"])


KINDS = {
    "l_orderkey": "numeric", "l_partkey": "numeric", "l_suppkey": "numeric", "l_linenumber": "numeric",
    "l_quantity": "numeric", "l_extendedprice": "numeric", "l_discount": "numeric", "l_tax": "numeric",
    "l_returnflag": "other", "l_linestatus": "other", "l_shipdate": "other", "l_note": "numeric",
}


def each(columns, body: str) -> str:
    """One SELECT per column, glued together; ``{c}`` is the column name."""
    return " UNION ALL ".join(body.replace("{c}", c) for c in columns)


@query(
    "select_by_kind",
    f"WITH g AS ({GAPPY_SQL}) "
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{k}' AS kind, count({c}) AS filled FROM g" for c, k in KINDS.items()),
)
def select_by_kind(spark, sf):
    return reshape.select_by_kind(gappy_lines(spark, sf))


@query(
    "date_range_filter",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem
 WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'""",
)
def date_range_filter(spark, sf):
    return reshape.date_range_filter(table(spark, sf, "lineitem"), "l_shipdate", "1997-01-01", "1997-12-31").select(*LINE_KEY, "l_quantity")


@query(
    "drop_rows_missing_target",
    f"WITH g AS ({GAPPY_SQL}) SELECT l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM g WHERE l_discount IS NOT NULL GROUP BY 1",
)
def drop_rows_missing_target(spark, sf):
    kept = reshape.drop_missing(gappy_lines(spark, sf), ["l_discount"])
    return kept.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query(
    "complete_rows",
    f"""WITH g AS ({GAPPY_SQL}) SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM g
 WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL AND l_returnflag IS NOT NULL GROUP BY 1""",
)
def complete_rows(spark, sf):
    kept = reshape.drop_missing(gappy_lines(spark, sf), ["l_discount", "l_tax", "l_returnflag"])
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("isin_filter", "SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'system')")
def isin_filter(spark, sf):
    return reshape.isin_filter(table(spark, sf, "conversations"), "role", ["user", "system"]).select("conv_id", "turn", "role", "text")


@query(
    "slice_dice",
    """SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem
 WHERE l_linestatus = 'F' AND l_returnflag IN ('A', 'R') GROUP BY 1""",
)
def slice_dice(spark, sf):
    part = reshape.slice_dice(table(spark, sf, "lineitem"), l_linestatus="F", l_returnflag=["A", "R"])
    return part.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query(
    "case_label",
    """SELECT CASE WHEN l_discount / 0.1 >= 0.9 THEN 'Excellent' WHEN l_discount / 0.1 >= 0.8 THEN 'Strong'
 WHEN l_discount / 0.1 >= 0.65 THEN 'Moderate' WHEN l_discount / 0.1 >= 0.5 THEN 'Weak' ELSE 'Very weak' END AS band,
 count(*) AS n FROM lineitem GROUP BY 1""",
)
def case_label(spark, sf):
    band = labels.quality_label(F.col("l_discount") / 0.1)
    return table(spark, sf, "lineitem").groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query(
    "melt_long",
    """SELECT o_orderkey, metric, value FROM (SELECT o_orderkey, 'o_totalprice' AS metric, o_totalprice AS value FROM orders
 UNION ALL SELECT o_orderkey, 'o_custkey', o_custkey::DOUBLE FROM orders)""",
)
def melt_long(spark, sf):
    return reshape.melt_long(table(spark, sf, "orders"), ["o_orderkey"], ["o_totalprice", "o_custkey"])


@query(
    "even_row_sample",
    f"""WITH o AS (SELECT {', '.join(LINE_KEY)}, l_quantity, row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) - 1 AS pos,
 count(*) OVER () AS n FROM lineitem),
 w AS (SELECT DISTINCT (i * (n - 1)) // 2999 AS pos FROM range(3000) r(i), (SELECT count(*) AS n FROM lineitem))
 SELECT {', '.join(LINE_KEY)}, l_quantity FROM o WHERE n <= 3000 OR pos IN (SELECT pos FROM w)""",
)
def even_row_sample(spark, sf):
    lines = table(spark, sf, "lineitem").select(*LINE_ORDER, "l_quantity")
    return reshape.even_row_sample(lines, LINE_ORDER, 3000).drop("l_shipdate")


@query(
    "row_label",
    f"""WITH g AS ({GAPPY_SQL}) SELECT concat_ws(' / ', 'l_returnflag: ' || l_returnflag, 'l_linestatus: ' || l_linestatus) AS segment,
 count(*) AS n FROM g GROUP BY 1""",
)
def row_label(spark, sf):
    named = reshape.with_row_label(gappy_lines(spark, sf), ["l_returnflag", "l_linestatus"], "segment")
    return named.groupBy("segment").agg(F.count("*").alias("n"))


@query("period_label", f"SELECT {period_sql('l_shipdate')} AS time_group, count(*) AS n FROM lineitem GROUP BY 1")
def period_label(spark, sf):
    named = cleaning.add_period(table(spark, sf, "lineitem"), "l_shipdate", PERIODS)
    return named.groupBy("time_group").agg(F.count("*").alias("n"))
