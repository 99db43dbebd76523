"""Extremely randomised trees: every node against its definition, parts against whole trees."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import models, trees


def table(spark, n=900, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 20, n), rng.normal(size=n).round(1), rng.integers(0, 3, n)]).astype(float)
    y = x[:, 0] * 2 + np.sin(x[:, 1]) * 5 - x[:, 2] + rng.normal(size=n)
    frame = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, w=rng.integers(1, 4, n).astype(float), id=np.arange(n))
    return spark.createDataFrame(frame), frame


def whole_trees(parts):
    """Each tree as nested tuples (axis, cut, left, right) or a value, its parts put together."""
    rows = parts.collect()
    by = {(r["tree"], r["path"], r["root"]): (trees._read(r), r["jump"]) for r in rows}

    def build(key, at):
        part, jump = by[key]
        if part["axis"][at] < 0:
            if jump is not None and jump[at] is not None:
                return build((key[0], jump[at], False), 0)
            return float(part["number"][at])
        down = int(part["left"][at])
        return int(part["axis"][at]), float(part["number"][at]), build(key, down), build(key, down + 1)

    return {r["tree"]: build((r["tree"], "", True), 0) for r in rows if r["root"]}


def predict(tree, row):
    while isinstance(tree, tuple):
        tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
    return tree


@pytest.mark.parametrize("part_points", [20_000, 40])
def test_every_node_follows_the_definition(spark, part_points):
    df, frame = table(spark)
    names = ["a", "b", "c"]
    points, middle = trees.points_of(df, names, "y", F.col("w"))
    rule = trees.Growth(None, 6, 3, 2, 7)
    parts = trees.fit_forest(points, names, 6, rule, part_points)
    made = whole_trees(parts)
    assert len(made) == 6 and len({str(t) for t in made.values()}) == 6
    x, y, w = frame[names].to_numpy(), frame["y"].to_numpy() - middle, frame["w"].to_numpy()

    def check(tree, at, depth):
        if not isinstance(tree, tuple):
            assert tree == pytest.approx(np.average(y[at], weights=w[at]), abs=1e-9) and len(at) >= 3
            return 1
        axis, cut, left, right = tree
        low, high = x[at, axis].min(), x[at, axis].max()
        assert len(at) >= 6 and low <= cut < high
        goes = x[at, axis] <= cut
        assert goes.sum() >= 3 and (~goes).sum() >= 3
        return check(left, at[goes], depth + 1) + check(right, at[~goes], depth + 1)

    leaves = [check(t, np.arange(len(x)), 0) for t in made.values()]
    assert min(leaves) > 50
    sums = {tuple(r[n] for n in names): r["total"] for r in trees.forest_sums(df, parts, names).collect()}
    for row in np.unique(x, axis=0)[::7]:
        assert sums[tuple(row)] == pytest.approx(sum(predict(t, row) for t in made.values()))
    share = trees.importance(parts, names)
    assert sum(share) == pytest.approx(1.0) and share[0] == max(share)


def test_depth_bound_and_leaves_above_the_parts(spark):
    df, _ = table(spark, 500, 3)
    points, _ = trees.points_of(df, ["a", "b", "c"], "y", F.lit(1.0))
    made = whole_trees(trees.fit_forest(points, ["a", "b", "c"], 3, trees.Growth(2, 2, 1, 3, 0), 10))
    deep = lambda t: 1 + max(deep(t[2]), deep(t[3])) if isinstance(t, tuple) else 0
    assert {deep(t) for t in made.values()} == {2}


def test_extra_trees_model(spark):
    df, frame = table(spark)
    fitted = models.fit_model(df, "y", ["a", "b", "c"], "ExtraTrees", params={"n_estimators": 40})
    scored = fitted.predict(df).toPandas()
    assert list(scored.columns) == [*frame.columns, "prediction"] and len(scored) == len(frame)
    assert 1 - ((scored.y - scored.prediction) ** 2).sum() / ((frame.y - frame.y.mean()) ** 2).sum() > 0.9
    again = models.fit_model(df.repartition(7), "y", ["a", "b", "c"], "ExtraTrees", params={"n_estimators": 40}).predict(df).toPandas()
    both = scored.merge(again, on="id")
    assert np.allclose(both.prediction_x, both.prediction_y)
    flat = models.fit_model(df.withColumn("y", F.lit(5.0)), "y", ["a"], "ExtraTrees", params={"n_estimators": 3}).predict(df)
    assert flat.filter("abs(prediction - 5) > 1e-9").count() == 0
    shares = fitted.importance().agg(F.sum("share")).first()[0]
    assert shares == pytest.approx(100.0)


def test_minimum_and_constant_features():
    rule = trees.Growth(None, 2, 1, 1, 0)
    x = np.array([[1.0, 5.0], [1.0, 6.0], [1.0, 9.0]])
    moments = {"n": np.ones(3), "w": np.ones(3), "s": np.array([1.0, 2.0, 9.0]), "q": np.array([1.0, 4.0, 81.0])}
    part = trees.grow_part(x, moments, rule, 0, np.random.default_rng(1))
    assert set(part["axis"]) == {-1, 1}  # the constant feature is never drawn
    assert sorted(part["number"][part["axis"] < 0]) == [1.0, 2.0, 9.0]


def test_best_cut_of_every_node(spark):
    """One feature set, no draw: each node has the largest gain of all thresholds between values."""
    df, frame = table(spark, 400, 9)
    names = ["a", "b", "c"]
    points, middle = trees.points_of(df, names, "y", F.col("w"))
    x, y, w = frame[names].to_numpy(), frame["y"].to_numpy() - middle, frame["w"].to_numpy()
    made = whole_trees(trees.fit_forest(points, names, 1, trees.Growth(None, 8, 4, 3, 0, best=True)))[0]

    def score(at):
        return (w[at] * y[at]).sum() ** 2 / w[at].sum()

    def check(tree, at):
        gains = {}
        for axis in range(3):
            values = np.unique(x[at, axis])
            for cut in (values[:-1] + values[1:]) / 2:
                left, right = at[x[at, axis] <= cut], at[x[at, axis] > cut]
                if min(len(left), len(right)) >= 4:
                    gains[axis, cut] = score(left) + score(right) - score(at)
        if not isinstance(tree, tuple):
            assert len(at) < 8 or not gains
            return
        goes = x[at, tree[0]] <= tree[1]
        assert score(at[goes]) + score(at[~goes]) - score(at) == pytest.approx(max(gains.values()))
        check(tree[2], at[goes])
        check(tree[3], at[~goes])

    check(made, np.arange(len(x)))


def test_random_forest_draws_rows_and_bins_above_the_parts(spark):
    df, frame = table(spark, 900, 4)
    names = ["a", "b", "c"]
    points, middle = trees.drawn_points(df, names, "y", F.lit(1.0), 60, 3)
    drawn = points.groupBy("tree").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).toPandas()
    assert len(drawn) == 60 and drawn["w"].mean() == pytest.approx(900, rel=0.03) and drawn["n"].mean() == pytest.approx(900 * (1 - np.exp(-1)), rel=0.03)
    rule = trees.Growth(None, 4, 2, 2, 3, best=True)
    x, y = frame[names].to_numpy(), frame["y"].to_numpy()
    for part_points in (20_000, 150):
        parts = trees.fit_forest(points, names, 60, rule, part_points)
        sums = {tuple(r[n] for n in names): r["total"] for r in trees.forest_sums(df, parts, names).collect()}
        predicted = np.array([sums[tuple(r)] for r in x]) / 60 + middle
        assert 1 - ((y - predicted) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.93
    assert parts.filter("root AND jump IS NOT NULL").count() == 60


def test_drawn_points_are_the_sums_of_the_drawn_rows(spark):
    """Every row by itself, as Spark's own hash draws it; rows in one partition are drawn in several tasks."""
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"a": rng.integers(0, 3, 700).astype(float), "b": rng.integers(0, 2, 700).astype(float), "y": rng.normal(size=700), "v": rng.integers(1, 4, 700).astype(float)})
    df, count, seed = spark.createDataFrame(frame).coalesce(1), 7, 5
    points, middle = trees.drawn_points(df, ["a", "b"], "y", F.col("v"), count, seed)
    plan = points._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan and "Generate" not in plan  # no row for each row and tree
    drawn = spark.range(700).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("tree"))
    drawn = drawn.withColumn("u", F.pmod(F.xxhash64(F.lit(seed), "tree", "row"), F.lit(1 << 52)) / F.lit(float(1 << 52))).toPandas()
    ends = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1)) for k in range(12)])
    numbers = df.select("*", F.monotonically_increasing_id().alias("row")).toPandas()
    each = drawn.merge(numbers, on="row")
    each["k"] = (each["u"].to_numpy()[:, None] >= ends).sum(axis=1)
    each = each[each["k"] > 0].assign(w=lambda d: d.k * d.v, s=lambda d: d.k * d.v * (d.y - middle), q=lambda d: d.k * d.v * (d.y - middle) ** 2)
    wanted = each.groupby(["tree", "a", "b"]).agg(n=("k", "size"), w=("w", "sum"), s=("s", "sum"), q=("q", "sum")).reset_index()
    got = points.toPandas().sort_values(["tree", "a", "b"], ignore_index=True)[list(wanted.columns)]
    pd.testing.assert_frame_equal(got, wanted, check_dtype=False, rtol=1e-9)


def test_forest_and_boosting_models(spark):
    df, frame = table(spark, 600, 6)
    for name, params in (("RandomForest", {"n_estimators": 30}), ("GradientBoosting", {"n_estimators": 60, "learning_rate": 0.1})):
        scored = models.fit_model(df, "y", ["a", "b", "c"], name, params=params).predict(df).toPandas()
        assert 1 - ((scored.y - scored.prediction) ** 2).sum() / ((scored.y - scored.y.mean()) ** 2).sum() > 0.9


def nodes(parts):
    return sorted((r["tree"], bytes(r["axis"]), bytes(r["left"]), np.frombuffer(r["number"]).round(9).tobytes()) for r in parts.collect())


def test_packed_points_grow_the_same_trees(spark, monkeypatch):
    """Points that fit one task travel packed, without a row per tree and point, and give the trees of the long way."""
    df, _ = table(spark, 500, 4)
    names = ["a", "b", "c"]
    rule = trees.Growth(None, 4, 2, 1, 3, best=True)
    points, middle = trees.drawn_points(df, names, "y", F.col("w"), 6, 3)
    blocks, same = trees.drawn_blocks(df, names, "y", F.col("w"), 6, 3)
    assert middle == same and nodes(trees.fit_drawn(blocks, 3, rule)) == nodes(trees.fit_forest(points, names, 6, rule))
    points, _ = trees.points_of(df, names, "y", F.col("w"))
    rule = trees.Growth(None, 4, 2, 1, 3)
    copied = points.crossJoin(spark.range(6).select(F.col("id").cast("int").alias("tree")))
    long_way = nodes(trees.fit_forest(copied, names, 6, rule))
    upper = []
    monkeypatch.setattr(trees, "_upper", lambda *_: upper.append(1))
    assert nodes(trees.fit_forest(points, names, 6, rule)) == long_way and not upper


def test_a_level_is_cut_without_sorting_it_again():
    rng = np.random.default_rng(0)
    node = np.sort(rng.integers(0, 9, 300))
    node = np.unique(node, return_inverse=True)[1]
    x = rng.integers(0, 12, (300, 2)).astype(float)
    moments = {"n": np.ones(300), "w": rng.random(300) + 0.5, "s": rng.normal(size=300), "q": np.ones(300)}
    begin = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    here = {m: np.add.reduceat(v, begin) for m, v in moments.items()}
    rule = trees.Growth(None, 4, 2, 2, 0, best=True)
    ranks = [np.lexsort((x[:, f], node)) for f in range(2)]
    for one, two in zip(trees.best_cuts(x, node, begin, moments, here, rule, ranks), trees.best_cuts(x, node, begin, moments, here, rule), strict=True):
        assert (one == two).all()
