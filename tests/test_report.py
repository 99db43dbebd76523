"""The full report counts a table once, and repeated rows by their hashes."""

import math
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame
from test_plans import plan

from tablewright.operators import facts, profile
from tablewright.operators.correlation import correlations
from tablewright.operators.quantiles import quantiles

ROWS = [(1, "a", 0.0), (1, "a", -0.0), (2, None, math.nan), (2, None, math.nan), (None, "a", None), (None, "a", None), (None, "a", None), (3, "b", math.inf)]


@pytest.mark.parametrize("few", [100, 1, 0])
def test_repeated_rows_are_exact(spark, few, monkeypatch):
    df = spark.createDataFrame(ROWS, "a long, b string, c double")
    assert profile.repeated_rows(df, few) == 4 and profile.repeated_rows(df.limit(0), few) == 0
    assert profile.repeated_rows(df.select(F.array("a").alias("a"), "b", "c")) == 4
    monkeypatch.setattr(F, "xxhash64", lambda *cols: F.lit(7).cast("long"))  # rows of one hash are still compared
    assert profile.repeated_rows(df, few) == 4


def test_facts_of_a_table_stand_for_its_own_counts(spark):
    df = spark.createDataFrame(ROWS, "a long, b string, c double")
    known = profile.table_facts(df)
    assert (known.rows, known.missing, known.infinite, known.duplicates, known.distinct) == (8, {"a": 3, "b": 2, "c": 5}, 1, 4, {"a": 3, "b": 2, "c": 3})
    for f in (lambda **k: profile.project_profile(df, "x", None, "a", **k), lambda **k: profile.validation_report(df, None, "a", **k), lambda **k: profile.smart_setup(df, "x", **k),
              lambda **k: profile.data_dictionary(df, ["a"], None, "a", **k)):
        assert sorted(map(str, f().collect())) == sorted(map(str, f(known=known).collect()))


def test_report_counts_a_table_once(spark, monkeypatch):
    df = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 3).cast("string").alias("w"), F.expr("date '2000-01-01' + int(id)").alias("d"))
    counted, seen = [], []
    distinct, first, collect = profile.distinct_values, DataFrame.first, DataFrame.collect
    monkeypatch.setattr(profile, "distinct_values", lambda df, values, *a, **k: (counted.append(set(values)), distinct(df, values, *a, **k))[1])
    monkeypatch.setattr(DataFrame, "first", lambda df: (seen.append(plan(df)), first(df))[1])
    monkeypatch.setattr(DataFrame, "collect", lambda df: (seen.append(plan(df)), collect(df))[1])
    made = facts.report_facts(df, "x", ["k"], "d", "v")
    seen.append(plan(made))
    assert [c for c in counted if "k" in c] == [{"k", "v", "w", "d"}]
    assert not any(re.search(r"hashpartitioning\(k#[^)]*w#", text) for text in seen)  # no row travels whole
    assert {r["value"] for r in collect(made) if r["item"] in ("duplicate_rows", "Duplicate rows")} == {"0", "Pass 0"}


def test_quantiles_copy_no_row_of_a_hot_value(spark, monkeypatch):
    """A bracket of one value is settled by counts; no row is turned into cells for it."""
    df = spark.range(5000).select((F.col("id") % 2).alias("v"), F.lit(None).cast("double").alias("none"), F.lit(3.0).alias("one"))
    monkeypatch.setattr("tablewright.operators.quantiles.running", None)
    made = {r["metric"]: r["q"] for r in quantiles(df, df.columns, [0.1, 0.9]).collect()}
    assert made == {"v": [0.0, 1.0], "none": None, "one": [3.0, 3.0]}


def test_many_correlations_stay_compiled(spark, monkeypatch):
    names = [f"c{i}" for i in range(14)]
    df = spark.range(400).select(*[F.when(F.col("id") % (i + 2) > 0, F.sin(F.col("id") * (i + 1))).alias(c) for i, c in enumerate(names)])
    seen = []
    first = DataFrame.first
    monkeypatch.setattr(DataFrame, "first", lambda df: (seen.append(plan(df)), first(df))[1])
    got = {r["left"]: r["correlation"] for r in correlations(df, [(c, "c0") for c in names[1:]]).collect()}
    widest = max(int(n) for text in seen for n in re.findall(r"Results \[(\d+)\]", text))
    assert 50 < widest <= 100  # spark.sql.codegen.maxFields
    known = df.agg(*[F.corr(c, "c0").alias(c) for c in names[1:]]).collect()[0]
    assert got.keys() == set(names[1:]) and all(abs(got[c] - known[c]) < 1e-9 for c in got)
