"""Density clusters against brute force: many features, crowded boxes, settled pairs, odd rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import clusters, density


def plain(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= least
    label, count = -np.ones(len(x), int), 0
    for i in range(len(x)):
        if label[i] == -1 and core[i]:
            todo, label[i] = [i], count
            while todo:
                j = todo.pop()
                if core[j]:
                    for k in np.flatnonzero(near[j] & (label == -1)):
                        label[k] = count
                        todo.append(k)
            count += 1
    return label, core


def blobs(rng, width):
    """Blobs of several widths, a bridge, noise, and one point that a fifth of the rows share."""
    parts = [rng.normal(size=(120, width)) * 0.1, rng.normal(size=(90, width)) * 0.3 + 2, rng.uniform(-3, 4, size=(80, width))]
    parts += [np.linspace(0, 1, 60)[:, None] * np.ones(width), np.tile(rng.normal(size=width) + 1, (90, 1)), rng.normal(size=(60, width)) * 0.01 - 2]
    x = np.vstack(parts)
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("width,eps,leaf", [(1, 0.02, 16), (2, 0.25, 32), (3, 0.4, 600), (8, 0.9, 16), (27, 2.0, 24), (27, 9.0, 24), (8, 40.0, 16)])
def test_dbscan_equals_brute_force(spark, width, eps, leaf):
    x = blobs(np.random.default_rng(width), width)
    names = [f"f{i}" for i in range(width)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=np.arange(len(x)) * 3))
    got = clusters.dbscan(df, names, "id", eps, 6, leaf_rows=leaf).orderBy("id").toPandas()
    label, core = plain(x, eps, 6)
    assert (got["core"].to_numpy() == core).all() and (got["cluster"].to_numpy() == label).all()
    assert list(got.columns) == [*names, "id", "cluster", "core"]


def test_no_leaf_holds_more_than_asked(spark):
    x = np.random.default_rng(3).normal(size=(3000, 9)) * 1e-3
    spots = spark.createDataFrame([(p.tolist(), 1, i) for i, p in enumerate(x)], "point array<double>, rows long, key long")
    density.work_dir(spark)
    placed, depth = density._laid_out(spots, 40)
    sizes = placed.groupBy("leaf").count()
    assert sizes.agg(F.max("count")).first()[0] <= 40 and placed.count() == 3000 and depth >= 2
    assert sizes.count() < 3000 / 40 * 6


def test_odd_rows_are_noise(spark):
    rows = [(1, 0.0, 1.0), (2, -0.0, 1.0), (3, None, 1.0), (4, math.nan, 1.0), (5, math.inf, 1.0), (6, 0.0, 1.0)]
    got = clusters.dbscan(spark.createDataFrame(rows, "id long, a double, cluster_ double"), ["a", "cluster_"], "id", 0.5, 3)
    assert {r["id"]: (r["cluster"], r["core"]) for r in got.collect()} == {1: (0, True), 2: (0, True), 6: (0, True), 3: (-1, False), 4: (-1, False), 5: (-1, False)}
    assert clusters.dbscan(spark.createDataFrame([], "id long, a double"), ["a"], "id").count() == 0


def test_components_of_chains_and_stars(spark):
    nodes = spark.range(400).withColumnRenamed("id", "node")
    links = [(i, i + 1) for i in range(0, 150)] + [(200, i) for i in range(201, 300)] + [(390, 310), (310, 350)]
    got = {r["node"]: r["component"] for r in density.components(nodes, spark.createDataFrame(links, "a long, b long")).collect()}
    want = {n: 0 if n <= 150 else 200 if 200 <= n < 300 else 310 if n in (310, 350, 390) else n for n in range(400)}
    assert got == want


def test_dense_regions_are_not_compared_again(spark, monkeypatch):
    """Leaves of core points that settled pairs already joined need no comparison."""
    x = np.random.default_rng(5).uniform(size=(3000, 2))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=np.arange(len(x))))
    asked, plain_met = {}, density._met

    def met(pairs, *rest):
        asked["pairs"] = pairs.count()
        return plain_met(pairs, *rest)

    monkeypatch.setattr(density, "_met", met)
    got = clusters.dbscan(df, ["a", "b"], "id", 0.3, 5, leaf_rows=64).toPandas()
    assert got["core"].all() and (got["cluster"] == 0).all()
    assert asked["pairs"] == 0
