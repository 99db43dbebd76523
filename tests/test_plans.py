"""What the plans must look like at scale."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

import __spark_entry__ as contract
from tablewright.functions.columns import distinct_values
from tablewright.operators import cleaning, reshape, series
from tablewright.operators.ordinal import with_ordinal
from tablewright.plans.registry import table


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(reshape.date_range_filter(table(spark, sf, "lineitem"), "l_shipdate", "1997-01-01", "1997-12-31").select("l_quantity"))
    assert "GreaterThanOrEqual(l_shipdate" in text and "LessThanOrEqual(l_shipdate" in text
    assert re.search(r"ReadSchema: struct<l_quantity:double,l_shipdate:timestamp_ntz>", text)


def test_positional_cut_is_a_filter(spark, sf):
    lines = table(spark, sf, "lineitem")
    split = series.chronological_split(lines, "l_shipdate", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    text = plan(lines.filter(split.train))
    assert "Exchange" not in text and "Window" not in text


def test_fences_are_literals(spark, sf):
    text = plan(cleaning.remove_iqr_outliers(table(spark, sf, "events"), ["value"]))
    assert "PushedFilters: [Or(And(GreaterThanOrEqual(value" in text and "Join" not in text


def test_global_order_needs_no_window(spark, sf):
    numbered, _ = with_ordinal(table(spark, sf, "lineitem").select("l_shipdate", "l_orderkey"), ["l_shipdate", "l_orderkey"])
    assert "Window" not in plan(numbered) and "SinglePartition" not in plan(numbered)


UNKEYED = ["even_row_sample", "rolling_mean_rows", "drift_report", "forward_fill", "time_series_cv", "roc_auc", "dimension_codes", "leaky_feature_rule"]


@pytest.mark.parametrize("name", UNKEYED)
def test_no_window_or_cross_join_over_everything(spark, sf, name):
    text = plan(contract.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for window in re.findall(r"\) Window\n.*?Arguments: (.*?)\n", text, re.S):
        assert not re.search(r", \[\], \[", window), window


PROFILES = [
    "distinct_counts", "data_dictionary", "infer_task_type", "identifier_columns", "date_candidates", "target_candidates", "recommend_features", "smart_auto_setup",
]


@pytest.mark.parametrize("name", PROFILES)
def test_profiles_do_not_copy_rows_per_column(spark, sf, name, monkeypatch):
    seen = []
    first = DataFrame.first
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "first", lambda df: (seen.append(plan(df)), first(df))[1])
    monkeypatch.setattr(DataFrame, "collect", lambda df: (seen.append(plan(df)), collect(df))[1])
    seen.append(plan(contract.queries()[name](spark, sf)))
    assert not any("Expand" in text for text in seen)


@pytest.mark.parametrize("few", [4_096, 50, 0])
def test_distinct_values_are_exact(spark, few):
    made = spark.range(6000).select(
        "id", (F.col("id") % 40).alias("some"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("hot"),
        F.expr("CASE id % 4 WHEN 0 THEN 0.0D WHEN 1 THEN -0.0D WHEN 2 THEN double('NaN') END").alias("odd"), F.lit(None).cast("double").alias("none"),
    )
    known = made.agg(*[F.count_distinct(c).alias(c) for c in made.columns]).first().asDict()
    assert known["odd"] == 2 and known["hot"] == 2001
    assert distinct_values(made, {c: F.col(c) for c in made.columns}, few=few) == known
    rough = distinct_values(made, {c: F.col(c) for c in made.columns}, enough=100, few=few)
    assert {c: rough[c] for c in ("some", "odd", "none")} == {c: known[c] for c in ("some", "odd", "none")} and rough["id"] > 5000
    assert set(distinct_values(made.limit(0), {c: F.col(c) for c in made.columns}, few=few).values()) == {0}
