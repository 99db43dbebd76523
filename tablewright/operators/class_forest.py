"""Random forests for classes over many rows, as models of Spark ML.

Features become bins, as in Spark's learner, and rows of equal bins and class one point.  How often a row comes up in a tree is
drawn inside tasks for every row; a tree then grows in one task from the counts of its points, by the rules of Spark's
learner: Gini impurity, features drawn for every node, a least number of rows in a node, sister leaves of one class joined.
The trees are written in Spark's own format, so scoring, importance and saving are those of any other model.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import trees
from tablewright.operators.boosting import bin_edges
from tablewright.session import scratch_path, work_dir

#: Points of one tree that a task holds.
TREE_POINTS = 131_072
#: Bytes of the counts of one level of a tree; deeper trees are left to Spark's learner.
LEVEL_BYTES = 1 << 26
NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: long, gain: double, "
    "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


def gini(counts: np.ndarray) -> np.ndarray:
    """Impurity by the last axis."""
    total = counts.sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, 1.0 - ((counts / total[..., None]) ** 2).sum(axis=-1), 0.0)


def grow(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, sizes: list[int], classes: int, depth: int, least: int, drawn: int, rng: np.random.Generator) -> list[dict]:
    """The nodes of one tree, parents before children: counts by class, axis (-1 in leaves), bin, gain, left (the right one follows)."""
    width, size = len(sizes), max(sizes)
    node, nodes, begin = np.zeros(len(bins), dtype=np.int64), [], 0
    level, at = 1, np.arange(len(bins))
    for step in range(depth + 1):
        made = np.zeros((level, width, size, classes))
        for f in range(width):
            cell = ((node * size) + bins[at, f]) * classes + label[at]
            made[:, f] = np.bincount(cell, weights=weight[at], minlength=level * size * classes).reshape(level, size, classes)
        counts = made[:, 0].sum(axis=1)
        left = np.cumsum(made, axis=2)[:, :, :-1]
        right = counts[:, None, None] - left
        total, own = counts.sum(axis=1), gini(counts)
        n_left, n_right = left.sum(axis=3), right.sum(axis=3)
        chosen = np.zeros((level, width), dtype=bool)
        np.put_along_axis(chosen, np.argsort(rng.random((level, width)), axis=1)[:, :drawn], True, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = own[:, None, None] - (n_left * gini(left) + n_right * gini(right)) / total[:, None, None]
        gain = np.where((n_left >= least) & (n_right >= least) & chosen[:, :, None], gain, -np.inf).reshape(level, -1)
        gain = np.concatenate([gain, np.full((level, 1), -np.inf)], axis=1)  # a table of constants has no cut
        place = gain.argmax(axis=1)
        best = gain[np.arange(level), place]
        split = (best > 0) & (own > 1e-12) & (step < depth)
        axis, cut = np.divmod(place, max(size - 1, 1))
        child = np.full(level, -1)
        child[split] = 2 * np.arange(int(split.sum()))
        for i in range(level):
            here = bool(split[i])
            nodes.append({
                "counts": counts[i], "impurity": float(own[i]), "axis": int(axis[i]) if here else -1, "cut": int(cut[i]),
                "gain": float(best[i]) if here else -1.0, "left": begin + level + int(child[i]) if here else -1,
            })
        begin += level
        on = split[node]
        at, node = at[on], node[on]
        node = child[node] + (bins[at, axis[node]] > cut[node])
        level = 2 * int(split.sum())
        if not level:
            break
    for k in range(len(nodes) - 1, -1, -1):  # sister leaves of one class are one leaf
        here = nodes[k]
        if here["left"] >= 0:
            two = nodes[here["left"]], nodes[here["left"] + 1]
            if all(x["left"] < 0 for x in two) and two[0]["counts"].argmax() == two[1]["counts"].argmax():
                here.update(left=-1, axis=-1, gain=-1.0)
    return nodes


def _rows(tree: int, nodes: list[dict], edges: list[np.ndarray]) -> list[tuple]:
    """Spark's node rows, numbered from the root."""
    order = [0]
    for k in order:  # grows while it is read
        if nodes[k]["left"] >= 0:
            order += [nodes[k]["left"], nodes[k]["left"] + 1]
    number = {k: i for i, k in enumerate(order)}
    made = []
    for k in order:
        x, leaf = nodes[k], nodes[k]["left"] < 0
        cut = (-1, [], -1) if leaf else (x["axis"], [float(edges[x["axis"]][x["cut"]])], -1)
        below = (-1, -1) if leaf else (number[x["left"]], number[x["left"] + 1])
        made.append((tree, (number[k], float(x["counts"].argmax()), x["impurity"], x["counts"].tolist(), int(x["counts"].sum()), x["gain"], *below, cut)))
    return made


def binned(rows: DataFrame, names: list[str], edges: list[np.ndarray]) -> DataFrame:
    """The bin of every feature as a number, and the class."""
    places = [F.size(F.filter(F.array(*[F.lit(float(e)) for e in edge]), trees._below(c))).cast("double") if len(edge) else F.lit(0.0) for c, edge in zip(names, edges, strict=True)]
    return rows.select(*[p.alias(f"b{i}") for i, p in enumerate(places)], F.col("_label").cast("double").alias("_label"))


def fit_class_forest(rows: DataFrame, names: list[str], learner: RandomForestClassifier, classes: int) -> RandomForestClassificationModel | None:
    """The forest that ``learner`` asks for over ``names`` and ``_label``; none if the points or the counts of a tree do not fit one task."""
    spark = rows.sparkSession
    if min(2.0 ** learner.getMaxDepth(), TREE_POINTS) * len(names) * learner.getMaxBins() * classes * 8 > LEVEL_BYTES:
        return None
    edges = bin_edges(rows, names, learner.getMaxBins())
    points = binned(rows, names, edges)
    if not trees.few_points(points, points.columns, TREE_POINTS):
        return None
    count, seed, depth, least = learner.getNumTrees(), learner.getSeed(), learner.getMaxDepth(), learner.getMinInstancesPerNode()
    width, drawn = len(names), _drawn(learner.getFeatureSubsetStrategy(), len(names))
    blocks, _ = trees.drawn_blocks(points, points.columns, "_label", F.lit(1.0), count, seed)
    sizes = [len(e) + 1 for e in edges]

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        tree = int(frame["tree"].iloc[0])
        x, moments = trees._points_of_blocks(frame["block"], width + 1)
        nodes = grow(x[:, :width].astype(np.int64), x[:, width].astype(np.int64), moments["w"], sizes, classes, depth, least, drawn, trees.node_rng(seed, tree, "c"))
        keys = ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"]
        cut = ["featureIndex", "leftCategoriesOrThreshold", "numCategories"]
        made = [dict(zip(keys, [*r[:-1], dict(zip(cut, r[-1], strict=True))], strict=True)) for _, r in _rows(tree, nodes, edges)]
        return pd.DataFrame({"treeID": [tree] * len(made), "nodeData": made})

    return _as_model(spark, blocks.groupBy("tree").applyInPandas(finish, NODES), learner, width, classes)


def _drawn(setting: str, width: int) -> int:
    """Features of a node, as Spark counts them."""
    if setting in ("sqrt", "auto"):
        return math.ceil(math.sqrt(width))
    if setting == "log2":
        return max(1, math.ceil(math.log2(width)))
    if setting == "onethird":
        return math.ceil(width / 3)
    if setting == "all":
        return width
    share = float(setting)
    return max(1, min(width, int(share) if "." not in setting else math.ceil(share * width)))


def _as_model(spark: SparkSession, nodes: DataFrame, learner: RandomForestClassifier, width: int, classes: int) -> RandomForestClassificationModel:
    """Nodes as a model: they take the place of those of a forest of one tree over a row of each class."""
    work_dir(spark)
    small, path = scratch_path(spark, "class-forest"), scratch_path(spark, "class-forest")
    tiny = spark.createDataFrame([(Vectors.dense([float(k)] * width), float(k)) for k in range(classes)], [learner.getFeaturesCol(), learner.getLabelCol()])
    learner.copy({learner.numTrees: 1, learner.minInstancesPerNode: 1}).fit(tiny).write().save(small)
    count = learner.getNumTrees()
    facts = json.loads(spark.read.text(f"{small}/metadata").first()[0])
    facts.update(numTrees=count)
    facts["paramMap"].update(numTrees=count, minInstancesPerNode=learner.getMinInstancesPerNode())
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    one = spark.read.parquet(f"{small}/treesMetadata").first()
    spark.createDataFrame([(k, one[1], one[2]) for k in range(count)], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    nodes.write.parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)
