"""Inputs that several queries share, as DataFrames and as the same SQL.

The given tables have no gaps, so gaps are declared by meaning: a zero discount or
tax counts as "not recorded", flag N as "no flag".  Every row is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.series import monthly_series
from tablewright.plans.registry import table

# Five calendar periods over the data: one is never reached, the last is open.
PERIODS = [
    ("Opening years", "1997-01-01", False),
    ("Build-up", "1998-06-30", True),
    ("Plateau", "1999-12-31", True),
    ("Late phase", "2001-12-31", True),
    ("Not reached", None, True),
]

PERIOD_SQL = """CASE WHEN {d} IS NULL THEN 'Unknown' WHEN {d} < TIMESTAMP '1997-01-01' THEN 'Opening years'
 WHEN {d} <= TIMESTAMP '1998-06-30' THEN 'Build-up' WHEN {d} <= TIMESTAMP '1999-12-31' THEN 'Plateau'
 WHEN {d} <= TIMESTAMP '2001-12-31' THEN 'Late phase' ELSE 'Not reached' END"""

LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LINE_ORDER = ["l_shipdate", *LINE_KEY]


def period_sql(column: str) -> str:
    return PERIOD_SQL.format(d=column)


def gappy_lines(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with zero discounts and taxes and flag N as missing, plus an empty column."""
    return table(spark, sf, "lineitem").withColumns(
        {
            "l_discount": F.nullif(F.col("l_discount"), F.lit(0.0)),
            "l_tax": F.nullif(F.col("l_tax"), F.lit(0.0)),
            "l_returnflag": F.nullif(F.col("l_returnflag"), F.lit("N")),
            "l_note": F.lit(None).cast("double"),
        }
    )


GAPPY_SQL = """SELECT * REPLACE (nullif(l_discount, 0.0) AS l_discount, nullif(l_tax, 0.0) AS l_tax,
 nullif(l_returnflag, 'N') AS l_returnflag), CAST(NULL AS DOUBLE) AS l_note FROM lineitem"""


def spiky_events(spark: SparkSession, sf: str) -> DataFrame:
    """events, where views carry no value."""
    return table(spark, sf, "events").withColumn("value", F.when(F.col("event_type") != "view", F.col("value")))


SPIKY_SQL = "SELECT * REPLACE (CASE WHEN event_type <> 'view' THEN value END AS value) FROM events"


def months(spark: SparkSession, sf: str) -> DataFrame:
    """One series: lineitem by month of shipping."""
    lines = table(spark, sf, "lineitem")
    exact = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(20,4)")
    return monthly_series(
        lines,
        "l_shipdate",
        {
            "revenue": F.sum(exact).cast("double"),
            "quantity": F.sum(F.col("l_quantity").cast("decimal(20,2)")).cast("double"),
            "lines": F.count("*").cast("double"),
            "discount": F.sum(F.col("l_discount").cast("decimal(20,2)")).cast("double") / F.count("*"),
            "tax": F.sum(F.col("l_tax").cast("decimal(20,2)")).cast("double") / F.count("*"),
        },
    )


MONTHS_SQL = """SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS month,
 sum((l_extendedprice * (1 - l_discount))::DECIMAL(20,4))::DOUBLE AS revenue,
 sum(l_quantity::DECIMAL(20,2))::DOUBLE AS quantity, count(*)::DOUBLE AS lines,
 sum(l_discount::DECIMAL(20,2))::DOUBLE / count(*) AS discount,
 sum(l_tax::DECIMAL(20,2))::DOUBLE / count(*) AS tax
 FROM lineitem GROUP BY 1"""


def segment_months(spark: SparkSession, sf: str) -> DataFrame:
    """Five series: orders by market segment and month.

    Orders are summed per customer and month before they meet the customer table.
    """
    orders = table(spark, sf, "orders")
    bought = monthly_series(
        orders,
        "o_orderdate",
        {"spent": F.sum(F.col("o_totalprice").cast("decimal(20,2)")), "orders": F.count("*")},
        ["o_custkey"],
    )
    customers = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    joined = bought.join(customers, bought.o_custkey == customers.c_custkey)
    return joined.groupBy("segment", "month").agg(
        F.sum("spent").cast("double").alias("revenue"),
        F.sum("orders").cast("double").alias("orders"),
        (F.sum("spent").cast("double") / F.sum("orders")).alias("ticket"),
    )


SEGMENTS_SQL = """SELECT c_mktsegment AS segment, date_trunc('month', o_orderdate)::TIMESTAMP AS month,
 sum(o_totalprice::DECIMAL(20,2))::DOUBLE AS revenue, count(*)::DOUBLE AS orders,
 sum(o_totalprice::DECIMAL(20,2))::DOUBLE / count(*) AS ticket
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""
