"""Small frames: gaps, NaN, infinities, ties, constant and empty columns."""

import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablewright.functions import labels, rules
from tablewright.operators import cleaning, correlation, metrics, olap, profile, reshape, series
from tablewright.operators.ordinal import running, windowed, with_ordinal
from tablewright.operators.quantiles import _bracketed, quantiles
from tablewright.operators.selection import first_rows, keys_at

NAN, INF = float("nan"), float("inf")


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_health_counts_nan_and_empty_table(spark):
    df = frame(spark, [(1, NAN, None), (1, NAN, None), (2, 3.0, None)], "a long, b double, c string")
    assert rows(profile.dataset_health(df)) == [(3, 3, 5, 1, 1)]
    assert rows(profile.dataset_health(df.limit(0))) == [(0, 3, 0, 0, 3)] or rows(profile.dataset_health(df.limit(0)))[0][0] == 0


def test_validation_flags_infinity_and_gate_raises(spark):
    df = frame(spark, [(1, INF), (2, 1.0)], "a long, b double")
    report = profile.validation_report(df, None, "b")
    found = {r["check_name"]: r["status"] for r in report.collect()}
    assert found["Infinite numeric values"] == "Fail" and found["Date column detected"] == "Warning"
    with pytest.raises(profile.QualityGateError):
        profile.quality_gate(report)


def test_numeric_profile_of_one_row_and_empty_column(spark):
    df = frame(spark, [(5.0, None)], "a double, b double")
    got = {r["metric"]: r for r in profile.numeric_profile(df).collect()}
    assert got["a"]["q50"] == 5.0 and got["a"]["std"] is None and got["b"]["n"] == 0 and got["b"]["mean"] is None


def test_correlation_of_constant_and_gappy_columns(spark):
    df = frame(spark, [(1.0, 2.0, 7.0, 1.0), (2.0, 4.0, 7.0, None), (3.0, 6.5, 7.0, 2.0), (4.0, None, 7.0, 4.0)], "a double, b double, c double, d double")
    got = {(r["left"], r["right"]): r["correlation"] for r in correlation.corr_matrix(df, ["a", "b", "c", "d"]).collect()}
    assert got["a", "c"] is None and got["c", "c"] is None
    assert got["a", "b"] == pytest.approx(0.99794, abs=1e-4) and got["b", "d"] == pytest.approx(1.0)
    assert got["a", "b"] == got["b", "a"] and got["a", "a"] == pytest.approx(1.0)


def test_mode_tie_takes_the_smaller_and_empty_gets_a_name(spark):
    df = frame(spark, [("b", None), ("a", None), ("b", None), ("a", None), (None, None)], "x string, y string")
    assert rows(cleaning.fill_mode(df, ["x", "y"]), "x")[0] == ("a", "Unknown")
    assert sum(r[0] == "a" for r in rows(cleaning.fill_mode(df, ["x", "y"]))) == 3


def test_fill_and_fence_leave_empty_and_constant_columns(spark):
    df = frame(spark, [(1.0, None, 4.0), (None, None, 4.0), (3.0, None, 4.0)], "a double, b double, c double")
    assert rows(cleaning.fill_numeric(df, ["a", "b"], "median"), "a") == [(1.0, None, 4.0), (2.0, None, 4.0), (3.0, None, 4.0)]
    assert cleaning.iqr_fences(df, ["b", "c"]) == {"b": None, "c": None}
    assert cleaning.cap_iqr_outliers(df, ["b", "c"]).count() == 3


def test_cap_lies_inside_the_fence_and_keeps_gaps(spark):
    df = frame(spark, [(float(i),) for i in range(20)] + [(500.0,), (None,)], "a double")
    fence = cleaning.iqr_fences(df, ["a"])["a"]
    capped = [r[0] for r in cleaning.cap_iqr_outliers(df, ["a"]).collect()]
    assert capped.count(None) == 1 and all(fence.low <= v <= fence.high for v in capped if v is not None)
    assert cleaning.remove_iqr_outliers(df, ["a"]).count() == 21


def test_correlated_fill_leaves_no_gap_and_falls_back(spark):
    df = frame(spark, [(float(i), 2.0 * i + 1 if i % 5 else None, float(i * i)) for i in range(40)], "a double, b double, c double")
    done, report = cleaning.fill_from_correlated(df, ["b"])
    got = {r["a"]: r["b"] for r in done.collect()}
    assert got[10.0] == pytest.approx(21.0) and report.first()["method"] == "Correlation estimate"
    few, note = cleaning.fill_from_correlated(df.limit(6), ["b"])
    assert note.first()["method"] == "Fallback median" and few.filter("b IS NULL").count() == 0


def test_unparsable_text_and_trim_collision(spark):
    df = frame(spark, [("2020-01-02", "7"), ("2020-13-01", "n/a"), (None, " 8 ")], "day string, x string")
    got = cleaning.coerce_numeric(cleaning.parse_date_column(df, "day"), keep=["day"])
    assert [r["x"] for r in got.collect()] == [7.0, None, 8.0] and got.filter("day IS NULL").count() == 2
    with pytest.raises(ValueError):
        cleaning.trim_columns(df.toDF("a", " a"))


def test_inf_and_nan_become_null(spark):
    df = frame(spark, [(INF,), (-INF,), (NAN,), (1.0,)], "a double")
    assert [r[0] for r in cleaning.inf_to_null(df).collect()] == [None, None, None, 1.0]


def test_period_label_edges(spark):
    df = frame(spark, [("2020-02-29 23:59:59",), ("2020-03-01 00:00:00",), ("2020-12-31 00:00:00",), ("2024-05-05 00:00:00",), (None,)], "d string")
    named = df.select(labels.period_label(F.col("d").cast("timestamp_ntz")).alias("p"))
    assert [r["p"] for r in named.collect()] == ["Pre-COVID baseline", "COVID shock", "COVID shock", "Recent period", "Unknown"]


def test_pivot_completes_levels_and_keeps_null_keys(spark):
    df = frame(spark, [("x", "p", "c1", 1.0), (None, "q", "c1", 5.0), ("x", "p", "c2", 3.0)], "a string, b string, c string, v double")
    got = {(r["a"], r["b"]): (r["v | c1"], r["v | c2"]) for r in olap.olap_pivot(df, ["a", "b"], "c", ["c1", "c2"], "v", "sum").collect()}
    assert got == {("x", "p"): (1.0, 3.0), ("x", "q"): (0.0, 0.0), (None, "p"): (0.0, 0.0), (None, "q"): (5.0, 0.0)}
    with pytest.raises(ValueError):
        olap.olap_pivot(df, ["a", "b"], "c", ["c1"], "v", max_grid=3)


def test_quantile_codes_merge_equal_edges(spark):
    df = frame(spark, [(float(v),) for v in [1, 1, 1, 2, 3, 4]], "v double")
    edges = series.quantile_edges(df, "v", 3)
    assert [r[0] for r in df.select(series.quantile_code(F.col("v"), edges)).collect()] == [0, 0, 0, 0, 1, 1]
    tied = frame(spark, [(1.0,), (1.0,), (1.0,), (9.0,)], "v double")
    assert {r["state"] for r in series.tertile_state(tied, "v").collect()} == {"One-level"}


def test_change_over_zero_is_null(spark):
    df = frame(spark, [("k", 1, 0.0), ("k", 2, 5.0), ("k", 3, 10.0)], "k string, t long, v double")
    assert [r["change"] for r in series.pct_change(df, "v", ["t"], ["k"], "day").orderBy("t").collect()] == [None, None, 1.0]


def test_even_sample_positions(spark):
    df = spark.range(10).withColumnRenamed("id", "t")
    assert sorted(r["t"] for r in reshape.even_row_sample(df, ["t"], 4).collect()) == [0, 3, 6, 9]
    assert reshape.even_row_sample(df, ["t"], 0).count() == 10 and reshape.even_row_sample(df, ["t"], 1).count() == 1


def test_chunks_equal_keyed_windows_with_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("k"), "id", (F.col("id") * 7 % 101).cast("double").alias("v"))
    build = lambda w: [{"m": F.avg("v").over(w.rowsBetween(-4, 0))}, {"n": F.lead("m", 2).over(w)}]
    cut = windowed(df, ["k"], ["id"], build, back=4, ahead=2, chunk=100)
    whole = windowed(df, ["k"], ["id"], build, grain="day")
    assert cut.exceptAll(whole).count() == 0 and whole.exceptAll(cut).count() == 0
    sums = dict(sums={"s": "v"}, lasts={"l": "g"})
    gaps = df.withColumn("g", F.when(F.col("id") % 400 == 0, F.col("v")))
    assert running(gaps, ["k"], ["id"], chunk=70, **sums).exceptAll(running(gaps, ["k"], ["id"], grain="day", **sums)).count() == 0


def test_ranked_quantiles_equal_builtin_with_a_hot_value(spark):
    df = spark.range(4000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 2 == 0, 5.0).otherwise(F.col("id") * 1.5).alias("v"))
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
    a = rows(df.groupBy("g").agg(F.transform(F.percentile("v", F.array(*map(F.lit, probs))), lambda x: F.round(x, 9)).alias("q")), "g")
    b = rows(quantiles(df, ["v"], probs, ["g"], chunk=50).select("g", F.transform("q", lambda x: F.round(x, 9))), "g")
    assert a == b


def test_bracketed_quantiles_equal_builtin(spark):
    odd = F.pmod(F.xxhash64("id"), F.lit(9973)).cast("double")
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(odd).alias("v"), (odd / 7).alias("w"), F.lit(2.0).alias("c"), F.lit(None).cast("double").alias("e"),
        F.when(F.col("id") < 2, F.col("id")).cast("double").alias("few"),
    )
    probs = [0.0, 0.01, 1 / 3, 0.5, 0.75, 0.99, 1.0]
    a = df.agg(*[F.percentile(c, F.array(*map(F.lit, probs))).alias(c) for c in df.columns]).first().asDict()
    b = {r["metric"]: r["q"] for r in quantiles(df, df.columns, probs, chunk=500).collect()}
    assert b["e"] is None and b["few"] == pytest.approx(a["few"])
    for c in ("v", "w", "c"):
        assert b[c] == pytest.approx(a[c], rel=1e-12)
    # Brackets that miss their rank fall back to ranking everything.
    rough = {r["metric"]: r["q"] for r in _bracketed(df, ["w"], probs, 500, sketch=10).collect()}
    assert rough["w"] == pytest.approx(a["w"], rel=1e-12)


def test_cut_by_key_equals_row_number(spark):
    df = spark.range(500).select((F.col("id") % 4).alias("d"), (F.col("id") * 37 % 500).alias("t"), F.when(F.col("id") > 3, F.col("id")).alias("u"))
    numbered, n = with_ordinal(df, ["d", "t"], "o")
    assert n == 500
    for k in (1, 124, 125, 126, 499, 500):
        mine = df.filter(first_rows(df, ["d", "t"], k))
        assert rows(mine, "d", "t") == rows(numbered.filter(F.col("o") < k).drop("o"), "d", "t")
    assert keys_at(df, ["u"], [500]) == {500: [None]}


def test_split_moves_to_the_event(spark):
    days = frame(spark, [(f"2019-{m:02d}-01",) for m in range(1, 13)] * 5 + [(f"2020-{m:02d}-01",) for m in range(1, 13)], "d string")
    df = days.select(F.col("d").cast("timestamp_ntz").alias("d"), F.monotonically_increasing_id().alias("i"))
    plain = series.chronological_split(df, "d", ["i"])
    assert (plain.train_rows, plain.test_rows) == (57, 15) and plain.method == "80/20 chronological split"
    moved = series.chronological_split(df, "d", ["i"], start="2019-06-01", resume="2020-01-01")
    assert (moved.train_rows, moved.test_start) == (60, "2020-01-01")
    wished = series.chronological_split(df, "d", ["i"], preferred="2019-12-01")
    assert wished.test_start == "2019-12-01" and df.filter(wished.train).count() == wished.train_rows


def test_metrics_edge_cases(spark):
    flat = frame(spark, [(2.0, 2.0), (2.0, 2.0)], "y double, p double")
    assert metrics.regression_metrics(flat, "y", "p").first()["r2"] == 1.0
    single = frame(spark, [("a", 0.2), ("a", 0.4)], "y string, s double")
    assert metrics.roc_auc(single, "y", {"a": "s"}).count() == 0
    wrong = frame(spark, [("a", "b"), ("a", "b"), ("b", "b")], "y string, p string")
    got = metrics.classification_metrics(wrong, "y", "p").first()
    assert got["accuracy"] == pytest.approx(1 / 3) and got["precision"] == pytest.approx(1 / 9)
    tied = frame(spark, [("a", 0.5), ("b", 0.5), ("a", 0.9), ("b", 0.1)], "y string, s double")
    for chunk in (1_000_000, 1):
        assert metrics.weighted_auc(tied, "y", {"a": "s"}, chunk=chunk).first()["auc"] == pytest.approx(0.875)


def test_name_rules():
    assert labels.follows_target("revenue_lag1", "revenue") and labels.follows_target("gross_revenue", "revenue")
    assert not labels.follows_target("tax", "revenue") and labels.says("order_id", "identifier")
    assert labels.find_date_col(["a", "l_shipdate"]) == "l_shipdate" and labels.find_date_col(["a"]) is None
    assert labels.project_title("file: /x/my-table_v2.csv") == "My Table V2" and labels.project_title("") == "Untitled Data Project"
    assert labels.named_after(["fed_funds", "my_rate"], rules.THEORY_RULES[0][2]) == "my_rate"


def test_policy_trace_adds_up(spark):
    data = [("k", i, float(100 + (i * 13) % 17), float(i % 7)) for i in range(40)]
    states = series.market_states(frame(spark, data, "k string, t long, v double, s double"), "t", "v", ["k"], "s", "day")
    traced = series.policy_trace(states, "t", ["k"], grain="day").orderBy("t").collect()
    assert len(traced) == 38 and traced[-1]["cumulative_reward"] == pytest.approx(math.fsum(r["reward"] for r in traced))


def test_box_points_are_all_rows_beyond_the_fences(spark):
    from tablewright.operators import profile

    rows = [(i, g, float(i % 10)) for i in range(40) for g in ("a", None)] + [(90, "a", 99.0), (91, "a", 99.0), (92, None, -50.0), (93, "b", None)]
    made = profile.box_points(spark.createDataFrame(rows, "id long, g string, v double"), "v", ["g"])
    assert sorted((r["id"], r["g"], r["side"]) for r in made.collect()) == [(90, "a", "high"), (91, "a", "high"), (92, None, "low")]
    assert profile.box_points(spark.createDataFrame([], "id long, g string, v double"), "v", ["g"]).count() == 0
