"""Cost-complexity pruning of a fitted decision tree.

One aggregate over the training rows gives the moments of every leaf; all that is above a leaf follows by addition.  A node
stays split if what its branch saves in impurity, as a share of all rows, is more than ``alpha`` for each leaf beyond the
first: the smallest tree among those of the least cost, the one that weakest-link pruning reaches.  The pruned tree scores
through the leaf number of the fitted one, so it stays an ordinary pipeline stage.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = "_leaf"


@dataclass
class Tree:
    """Nodes in the order of the tree, a node before its branches; feature -1 is a leaf.

    ``moments`` holds for each node the number of rows, their weight, and the label's sum and sum of squares around its
    middle, or the weight of every class."""

    feature: np.ndarray
    left: np.ndarray
    right: np.ndarray
    moments: np.ndarray
    classes: bool

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.feature < 0)

    @property
    def risk(self) -> np.ndarray:
        """Impurity of every node times its share of the weight."""
        weight, rest = self.moments[:, 1], self.moments[:, 2:]
        with np.errstate(divide="ignore", invalid="ignore"):
            apart = weight - (rest**2).sum(axis=1) / weight if self.classes else rest[:, 1] - rest[:, 0] ** 2 / weight
        return np.where(weight > 0, np.maximum(apart, 0.0), 0.0) / max(weight[0], 1e-300)


def shape_of(model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Split feature, left and right branch of every node, read from the model's printed form."""
    feature, left, right, open_nodes = [], [], [], []
    for line in model.toDebugString.splitlines():
        found = re.match(r"\s*(?:If \(feature (\d+)|(Predict))", line)
        if not found:
            continue
        at = len(feature)
        if open_nodes:
            above = open_nodes[-1]
            if left[above] < 0:
                left[above] = at
            else:
                right[above] = at
                open_nodes.pop()
        feature.append(-1 if found[2] else int(found[1]))
        left.append(-1)
        right.append(-1)
        if not found[2]:
            open_nodes.append(at)
    return np.array(feature), np.array(left), np.array(right)


def measured(model, ready: DataFrame, classes: int = 0, middle: float = 0.0) -> Tree:
    """The tree with the moments of its training rows (``features``, ``_label``, ``_weight``); one row per leaf is collected."""
    feature, left, right = shape_of(model)
    weight, label = F.col("_weight"), F.col("_label") - F.lit(middle)
    sums = [F.sum(F.when(F.col("_label") == k, weight).otherwise(0.0)) for k in range(classes)] or [F.sum(weight * label), F.sum(weight * label * label)]
    placed = hidden(model).transform(ready.select("features", "_label", "_weight"))
    found = placed.groupBy(LEAF).agg(F.count("*").cast("double"), F.sum(weight), *sums).collect()
    moments = np.zeros((len(feature), 2 + len(sums)))
    leaves = np.flatnonzero(feature < 0)
    for row in found:
        moments[leaves[int(row[0])]] = row[1:]
    for at in range(len(feature) - 1, -1, -1):
        if feature[at] >= 0:
            moments[at] = moments[left[at]] + moments[right[at]]
    return Tree(feature, left, right, moments, classes > 0)


def hidden(model):
    """The model with its leaf number as only output."""
    made = model.copy()
    for name in ("predictionCol", "probabilityCol", "rawPredictionCol"):
        if made.hasParam(name):
            made.set(made.getParam(name), "")
    return made.setLeafCol(LEAF)


def ends(tree: Tree, alpha: float, min_split: int) -> np.ndarray:
    """Which nodes end a branch once the tree is pruned.

    A node of fewer than ``min_split`` rows is never split; splits do not depend on each other, so taking them back gives the
    tree that would have grown under that bound."""
    risk = tree.risk
    closed = (tree.feature < 0) | (tree.moments[:, 0] < min_split)
    cost = risk + alpha
    for at in range(len(risk) - 1, -1, -1):
        if not closed[at]:
            branch = cost[tree.left[at]] + cost[tree.right[at]]
            if alpha > 0 and branch >= cost[at] - 1e-12 * max(risk[0], 1e-300):
                closed[at] = True
            else:
                cost[at] = branch
    return closed


def kept_nodes(tree: Tree, closed: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Nodes that stay, and for every leaf of the fitted tree the node that now answers for it."""
    stay, answer = [], np.zeros(len(closed), dtype=int)
    todo = [(0, -1)]
    while todo:
        at, above = todo.pop()
        own = at if above < 0 and closed[at] else above
        if above < 0:
            stay.append(at)
        answer[at] = own
        if tree.feature[at] >= 0:
            todo += [(tree.left[at], own), (tree.right[at], own)]
    return stay, answer[tree.leaves]


def shares(tree: Tree, stay: list[int], closed: np.ndarray, features: int) -> list[float]:
    """Impurity that the splits on every feature save, as shares of one."""
    risk, saved = tree.risk, np.zeros(features)
    for at in stay:
        if not closed[at]:
            saved[tree.feature[at]] += risk[at] - risk[tree.left[at]] - risk[tree.right[at]]
    return (saved / saved.sum() if saved.sum() else saved).tolist()


def pruned_stages(model, ready: DataFrame, alpha: float, min_split: int, classes: int = 0) -> tuple[list, list[float]]:
    """Stages that score the pruned tree, and its importances.

    Numbers get ``prediction``; classes also ``probability`` (an array).  No rows: the fitted tree is kept as it is."""
    middle = 0.0 if classes else float(ready.agg(F.avg("_label")).first()[0] or 0.0)
    tree = measured(model, ready, classes, middle)
    closed = ends(tree, alpha, min_split)
    stay, answer = kept_nodes(tree, closed)
    weight = np.maximum(tree.moments[answer, 1], 1e-300)
    place = f"cast(`{LEAF}` AS int) + 1"
    if classes:
        chance = tree.moments[answer, 2:] / weight[:, None]
        rows = ", ".join("array(" + ", ".join(f"double('{v!r}')" for v in row) + ")" for row in chance.tolist())
        best = ", ".join(f"double('{v}')" for v in chance.argmax(axis=1))
        made = f"element_at(array({rows}), {place}) AS probability, element_at(array({best}), {place}) AS prediction"
    else:
        values = ", ".join(f"double('{v!r}')" for v in (middle + tree.moments[answer, 2] / weight).tolist())
        made = f"element_at(array({values}), {place}) AS prediction"
    return [hidden(model), SQLTransformer(statement=f"SELECT *, {made} FROM __THIS__")], shares(tree, stay, closed, model.numFeatures)
