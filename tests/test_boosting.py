"""Leaf-wise boosting against a plain best-first growth that scans rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import boosting, models, trees
from tablewright.operators.boosting import Boosting


def frame(n=700, seed=2):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 15, n), rng.normal(size=n).round(2), rng.integers(0, 3, n)]).astype(float)
    y = np.where(x[:, 0] > 9, 8, 0) + x[:, 1] ** 2 + rng.normal(size=n) * 0.3
    return pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, w=rng.integers(1, 4, n).astype(float), id=np.arange(n))


def plain_tree(x, w, g, rule, edges):
    """Best-first growth by scanning every threshold of every leaf."""

    def split(at):
        best = (0.0, None)
        total = g[at].sum() ** 2 / (w[at].sum() + rule.l2)
        for f, edge in enumerate(edges):
            for cut in edge:
                left = at[x[at, f] <= cut]
                right = at[x[at, f] > cut]
                if min(len(left), len(right)) < rule.min_leaf:
                    continue
                gain = sum(g[s].sum() ** 2 / (w[s].sum() + rule.l2) for s in (left, right)) - total
                if gain > best[0] + 1e-9:
                    best = (gain, (f, cut, left, right))
        return best

    leaves = [(np.arange(len(x)), split(np.arange(len(x))))]
    gains = []
    while len(leaves) < rule.max_leaves:
        i = max(range(len(leaves)), key=lambda k: leaves[k][1][0])
        gain, how = leaves[i][1]
        if how is None:
            break
        gains.append(gain)
        leaves[i : i + 1] = [(part, split(part)) for part in how[2:]]
    step = np.zeros(len(x))
    for at, _ in leaves:
        step[at] = -rule.rate * g[at].sum() / (w[at].sum() + rule.l2)
    return step, len(leaves), gains


@pytest.mark.parametrize("here", [20_000, 10])
def test_trees_equal_plain_growth(spark, here):
    data = frame()
    df = spark.createDataFrame(data).repartition(3)
    names = ["a", "b", "c"]
    rule = Boosting(rounds=4 if here == 10 else 30, rate=0.3, max_leaves=7, min_leaf=12, l2=0.7)
    parts, middle = boosting.fit_boosting(df, names, "y", F.col("w"), rule, bins=16, here=here)
    edges = boosting.bin_edges(df, names, 16)
    assert len(edges[0]) == 14 and len(edges[1]) <= 15 and len(edges[2]) == 2
    x, y, w = data[names].to_numpy(), data["y"].to_numpy(), data["w"].to_numpy()
    assert middle == pytest.approx(np.average(y, weights=w))
    predicted, rows = np.full(len(y), middle), sorted(parts.collect(), key=lambda r: r["tree"])
    assert len(rows) == rule.rounds
    for row in rows:
        step, leaves, gains = plain_tree(x, w, w * (predicted - y), rule, edges)
        part = trees._read(row)
        assert (part["axis"] < 0).sum() == leaves <= rule.max_leaves
        assert np.allclose(part["number"][trees.walk(part, x)], step)
        assert sum(row["gain"]) == pytest.approx(sum(gains))
        predicted += step
    sums = {tuple(r[n] for n in names): r["total"] for r in trees.forest_sums(df, parts, names).collect()}
    assert np.allclose([sums[tuple(r)] + middle for r in x], predicted)


def test_settings_matter_and_leaves_are_met(spark):
    data = frame(900, 5)
    df = spark.createDataFrame(data)
    fit = lambda **p: models.fit_model(df, "y", ["a", "b", "c"], "HistGradientBoosting", params={"max_iter": 20, "learning_rate": 0.2, **p})
    fitted = fit()
    counts = [(trees._read(r)["axis"] < 0).sum() for r in fitted.forest["parts"].collect()]
    assert max(counts) == 15 and len(counts) == 20
    plain = fitted.predict(df).toPandas()
    assert 1 - ((plain.y - plain.prediction) ** 2).sum() / ((plain.y - plain.y.mean()) ** 2).sum() > 0.9
    heavy = fit(l2_regularization=500.0).predict(df).toPandas()
    assert heavy.prediction.std() < plain.prediction.std() * 0.95
    few = fit(min_samples_leaf=300)
    assert max((trees._read(r)["axis"] < 0).sum() for r in few.forest["parts"].collect()) <= 3
    assert fitted.importance().orderBy(F.desc("share")).first()["feature"] == "a"


def test_constant_target(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), F.lit(3.0).alias("y"))
    assert models.fit_model(df, "y", ["a"], "HistGradientBoosting", params={"max_iter": 3}).predict(df).filter("abs(prediction - 3) > 1e-9").count() == 0


def test_groups_of_equal_bins_are_one_point_and_nodes_are_weighed_together(monkeypatch):
    """Distinct bins, not their groups, look for their leaf, and a level of nodes is one step; a bound that is never reached changes nothing."""
    rng = np.random.default_rng(1)
    cells = np.array([(a, b) for a in range(12) for b in range(6)])
    made = pd.DataFrame(np.repeat(cells, 20, axis=0), columns=["b0", "b1"]).assign(k=np.tile(np.arange(20), len(cells)), n=2, w=2.0)
    made["s"] = rng.normal(size=len(made))
    edges = [np.arange(11) + 0.5, np.arange(5) + 0.5]
    points, steps = set(), []
    counted, leaf = boosting._histogram, boosting.Tree.leaf
    monkeypatch.setattr(boosting, "_histogram", lambda *asked: steps.append(1) or counted(*asked))
    monkeypatch.setattr(boosting.Tree, "leaf", lambda tree, bins, *begin: points.add(len(bins)) or leaf(tree, bins, *begin))
    rule = Boosting(rounds=3, rate=0.3, max_leaves=2**30, min_leaf=2, l2=0.0, subsample=0.5)
    free = boosting.boost_here(made, rule, edges)
    assert points == {len(cells)} and len(steps) < 3 * 12
    most = max(len(a) // 4 for a in free["axis"])
    tight = boosting.boost_here(made, Boosting(rounds=3, rate=0.3, max_leaves=(most + 1) // 2, min_leaf=2, l2=0.0, subsample=0.5), edges)
    for column in ("axis", "left", "number"):
        assert list(free[column]) == list(tight[column])
