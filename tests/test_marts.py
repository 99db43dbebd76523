"""Marts that grow: only new partitions are read, and the result is that of a full recompute."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import marts
from tablewright.session import scratch_path


def frame(months, n=200, seed=1):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({
        "month": rng.choice(months, n), "kind": rng.choice(["a", "b"], n), "v": np.where(rng.random(n) < 0.1, np.nan, 1e9 + rng.normal(size=n)), "who": rng.integers(0, 60, n)
    }).astype({"v": object}).where(lambda d: d.notna(), None)


SCHEMA = "month string, kind string, v double, who long"


@pytest.fixture
def mart(spark):
    return marts.Mart(scratch_path(spark, "mart"), "month", ["kind"], ["v"], ["who"])


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path.removeprefix("file:")) for f in names if f.endswith(".parquet")}


def result(spark, mart, df, by=None):
    return marts.merged(spark, mart, mart.partials(df).schema, by).toPandas().sort_values(list(by or mart.keys)).reset_index(drop=True)


def same(made, df, by):
    known = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count("v").alias("v_n"), F.avg("v").alias("v_mean"), F.stddev("v").alias("v_std"), F.min("v").alias("v_min"), F.max("v").alias("v_max")
    ).toPandas().sort_values(by).reset_index(drop=True)
    pd.testing.assert_frame_equal(made[known.columns], known, check_dtype=False, rtol=1e-6)


def test_a_new_month_is_all_that_is_read(spark, mart, tmp_path):
    source = str(tmp_path / "lines")
    first = spark.createDataFrame(frame(["2001-01", "2001-02"]).to_dict("records"), SCHEMA)
    first.write.partitionBy("month").parquet(source)
    read = lambda: spark.read.schema("kind string, v double, who long, month string").parquet(source)
    assert sorted(marts.refresh(read(), mart)) == ["2001-01", "2001-02"]
    before = files(mart.path)
    spark.createDataFrame(frame(["2001-03"], 90, 2).to_dict("records"), SCHEMA).write.mode("append").partitionBy("month").parquet(source)
    due = marts.due_partitions(read(), mart)
    assert due == ["2001-03"]
    plan = mart.partials(read().filter(marts._is_one_of("month", due)))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "2001-03" in plan
    assert marts.refresh(read(), mart) == ["2001-03"] and before < files(mart.path)
    same(result(spark, mart, read()), read(), ["kind"])
    same(result(spark, mart, read(), ["month"]), read(), ["month"])
    assert marts.refresh(read(), mart) == []


def test_late_changed_and_missing_months(spark, mart):
    rows = spark.createDataFrame(frame(["2001-01", "2001-02", None]).to_dict("records"), SCHEMA)
    assert set(marts.refresh(rows, mart)) == {"2001-01", "2001-02", None}
    late = rows.unionByName(spark.createDataFrame([("2001-01", "c", 5.0, 1)], SCHEMA))
    assert marts.refresh(late, mart) == ["2001-01"]
    same(result(spark, mart, late), late, ["kind"])
    edited = late.withColumn("v", F.when(F.col("month") == "2001-02", F.col("v") * 2).otherwise(F.col("v")))
    assert marts.refresh(edited, mart) == [] and marts.refresh(edited, mart, again=["2001-02"]) == ["2001-02"]
    same(result(spark, mart, edited), edited, ["kind"])
    left = edited.filter("month IS NULL OR month <> '2001-01'")
    assert marts.refresh(left, mart, gone=["2001-01"]) == []
    same(result(spark, mart, left), left, ["kind"])


def test_sketches_and_empty_tables(spark, mart):
    rows = spark.createDataFrame(frame(["2001-01", "2001-02", "2001-03"], 2000).to_dict("records"), SCHEMA)
    marts.refresh(rows, mart)
    made = result(spark, mart, rows)
    assert (made["who_distinct"] - 60).abs().max() <= 3
    none = marts.Mart(scratch_path(spark, "none"), "month", ["kind"], ["v"])
    assert marts.refresh(rows.limit(0), none) == [] and len(result(spark, none, rows)) == 0
