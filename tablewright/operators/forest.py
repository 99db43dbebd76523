"""Isolation forest (Liu, Ting, Zhou 2008): small random trees, short paths are anomalies.

Only the rows a tree is built from are sampled, which is the method; every row is scored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions.columns import spread_rows
from tablewright.operators.quantiles import quantile_values
from tablewright.session import work_dir

TREE_ROWS = 256
POOL = 20  # candidate rows per tree row
NODE = "tree long, node long, axis long, cut double, size long"


def _usual_depth(rows: float) -> float:
    """Mean path length of an unsuccessful search among ``rows`` rows."""
    if rows <= 1:
        return 0.0
    if rows == 2:
        return 1.0
    return 2.0 * (math.log(rows - 1) + np.euler_gamma) - 2.0 * (rows - 1) / rows


def _draw(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) fixed by the row and the seed."""
    return F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def build_trees(matrix: DataFrame, features: Sequence[str], key: str, trees: int = 100, tree_rows: int = TREE_ROWS, seed: int = 0) -> tuple[pd.DataFrame, int]:
    """All tree nodes (at most trees x 2 x tree_rows rows) and the rows per tree."""
    names = list(features)
    total = matrix.count()
    sized = min(tree_rows, total)
    share = min(1.0, POOL * trees * tree_rows / max(total, 1))
    pool = matrix.select(F.col(key).alias("_k"), *names).filter(_draw(seed, F.col("_k")) < share)
    # Each tree takes its own smallest draws; the limit per tree applies before the shuffle.
    many = pool.withColumn("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long"))))
    many = many.withColumn("_d", F.xxhash64("_k", "tree", F.lit(seed + 1)))
    first = Window.partitionBy("tree").orderBy("_d", "_k")
    chosen = many.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= sized)
    limit = max(1, math.ceil(math.log2(max(sized, 2))))

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        tree = int(frame["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        nodes = []
        todo = [(1, frame.sort_values(["_d", "_k"])[names].to_numpy(dtype=float), 0)]
        while todo:
            node, rows, depth = todo.pop()
            open_axes = np.flatnonzero(np.ptp(rows, axis=0) > 0) if len(rows) > 1 else np.array([], dtype=int)
            if depth >= limit or not len(open_axes):
                nodes.append((tree, node, -1, 0.0, len(rows)))
                continue
            axis = int(rng.choice(open_axes))
            low, high = rows[:, axis].min(), rows[:, axis].max()
            cut = float(rng.uniform(low, high))
            left = rows[:, axis] <= cut
            nodes.append((tree, node, axis, cut, len(rows)))
            todo.append((2 * node, rows[left], depth + 1))
            todo.append((2 * node + 1, rows[~left], depth + 1))
        return pd.DataFrame(nodes, columns=["tree", "node", "axis", "cut", "size"])

    return chosen.groupBy("tree").applyInPandas(grow, NODE).toPandas(), sized


def anomaly_scores(matrix: DataFrame, features: Sequence[str], nodes: pd.DataFrame, tree_rows: int, name: str = "score") -> DataFrame:
    """Negative 2^(-mean path / usual path) per row: the lower, the more unusual."""
    width = int(nodes["node"].max()) + 1
    count = int(nodes["tree"].max()) + 1
    axis = np.full((count, width), -1)
    cut, rest = np.zeros((count, width)), np.zeros((count, width))
    at = (nodes["tree"].to_numpy(dtype=int), nodes["node"].to_numpy(dtype=int))
    axis[at], cut[at] = nodes["axis"], nodes["cut"]
    rest[at] = [_usual_depth(s) for s in nodes["size"]]
    usual = _usual_depth(tree_rows) or 1.0

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        path = np.zeros(len(x))
        for tree in range(count):
            node = np.ones(len(x), dtype=int)
            depth = np.zeros(len(x))
            moving = axis[tree, node] >= 0
            while moving.any():
                here = node[moving]
                right = x[moving, axis[tree, here]] > cut[tree, here]
                node[moving] = 2 * here + right
                depth[moving] += 1
                moving = axis[tree, node] >= 0
            path += depth + rest[tree, node]
        return pd.Series(-(2.0 ** (-(path / count) / usual)))

    return matrix.withColumn(name, score(*features))


def isolation_forest(
    matrix: DataFrame, features: Sequence[str], key: str, contamination: float = 0.05, trees: int = 100, seed: int = 0, **how
) -> DataFrame:
    """Rows with ``anomaly_score`` (below 0 is an anomaly) and ``anomaly_label``.

    The zero point is the exact quantile of the scores at the expected anomaly share.
    """
    nodes, sized = build_trees(matrix, features, key, trees, seed=seed)
    work_dir(matrix.sparkSession)
    # walking all trees is the costly part: over all cores, and once for the quantile's passes and the result
    scored = anomaly_scores(spread_rows(matrix), features, nodes, sized, "_s").checkpoint()
    edge = quantile_values(scored, ["_s"], [contamination], **how)["_s"][0]
    shifted = F.col("_s") - F.lit(edge)
    return scored.withColumn("anomaly_score", shifted).drop("_s").withColumn(
        "anomaly_label", F.when(F.col("anomaly_score") < 0, "Anomaly").otherwise("Normal")
    )


def most_unusual(scored: DataFrame, key: str, rows: int = 100) -> DataFrame:
    return scored.orderBy("anomaly_score", key).limit(rows)
