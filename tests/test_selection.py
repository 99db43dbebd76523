"""Positional cuts against sorted rows, whatever the key type and the session zone."""

import datetime
import math
import os
import time

import pytest

from pyspark.sql import functions as F

from tablewright.operators.selection import cuts
from tablewright.operators.series import chronological_split, fold_bounds


@pytest.fixture
def other_zone(spark):
    zone, here = spark.conf.get("spark.sql.session.timeZone"), os.environ.get("TZ")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    os.environ["TZ"] = "UTC"
    time.tzset()
    yield
    spark.conf.set("spark.sql.session.timeZone", zone)
    if here is None:
        del os.environ["TZ"]
    else:
        os.environ["TZ"] = here
    time.tzset()


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_times_in_another_session_zone(spark, other_zone, kind):
    step = "86400" if kind == "date" else "3600"
    rows = spark.range(2000).select("id", F.expr(f"cast(timestamp_seconds(1130000000 + id * {step}) as {kind})").alias("t"))
    for k, cut in zip((1, 777, 1600, 2000), cuts(rows, ["t", "id"], [1, 777, 1600, 2000]), strict=True):
        assert rows.filter(cut).agg(F.count("*"), F.max("id")).first()[:] == (k, k - 1)
    split = chronological_split(rows, "t", ["id"])
    assert rows.filter(split.train).count() == split.train_rows == 1600
    assert [rows.filter(b).count() for b in fold_bounds(rows, ["t", "id"], 4)] == [400, 800, 1200, 1600, 2000]


def test_nan_and_null_keys(spark):
    values = [2.0, math.nan, None, -1.0, math.nan, 0.0, -0.0, None, 2.0, math.inf]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    place = lambda v: (2, 0) if v is None else (1, 0) if math.isnan(v) else (0, v)
    order = [i for i, _ in sorted(enumerate(values), key=lambda r: (place(r[1]), r[0]))]
    asked = list(range(len(values) + 1))
    for k, cut in zip(asked, cuts(df, ["v", "id"], asked), strict=True):
        assert sorted(r["id"] for r in df.filter(cut).collect()) == sorted(order[:k])


def test_ties_without_a_tiebreak_come_whole(spark):
    df = spark.createDataFrame([(s, d) for s in "aab" for d in (datetime.date(2020, 1, 1), datetime.date(2020, 1, 2))], "s string, d date")
    found = [df.filter(c).count() for c in cuts(df, ["d", "s"], [1, 2, 3, 4, 6])]
    assert found == [2, 2, 3, 5, 6]
