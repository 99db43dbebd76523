"""Gradient boosting on histograms with trees that grow leaf by leaf, best gain first.

Features become bins, and rows of equal bins one point with its rows, weight and weighted sum of the target; with squared
loss these carry every gradient.  A histogram of a leaf is one aggregate over the points; the histogram of the larger child
is that of its parent less that of its sibling.  Which leaves a tree will split is simulated with the gains known so far,
and all leaves that are reached without known children are opened in one pass, so a tree takes about as many passes as it
has levels.  When the points fit one task, the same growth runs inside that task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import one_row
from tablewright.operators.trees import PART, _binary
from tablewright.session import scratch_path, work_dir

#: Points on which one task runs all rounds alone.
HERE_POINTS = 100_000
#: Rounds after which the predictions so far are written down.
KEPT_ROUNDS = 25
#: Random groups of rows; a round on a share of the rows takes that share of the groups.
GROUPS = 20
SUMS = ["n", "h", "g"]  # rows, weight, gradient


@dataclass(frozen=True)
class Boosting:
    rounds: int
    rate: float
    max_leaves: int
    min_leaf: int
    l2: float
    max_depth: int | None = None
    subsample: float = 1.0
    seed: int = 0

    def takes(self, number: int, group: np.ndarray) -> np.ndarray:
        """Which groups of rows a round works on: a share of them, drawn anew each round."""
        if self.subsample >= 1:
            return np.ones(len(group), dtype=bool)
        drawn = np.random.default_rng([self.seed, number]).permutation(GROUPS)[: max(1, round(self.subsample * GROUPS))]
        return np.isin(group, drawn)


@dataclass
class Leaf:
    """A node of the growing tree: its histogram (features, bins, sums) and its best split."""

    sums: np.ndarray
    histogram: np.ndarray | None
    depth: int
    axis: int = -1
    cut: int = -1
    gain: float = 0.0
    small: int = 0
    children: tuple[int, int] | None = None


@dataclass
class Tree:
    axis: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def leaf(self, bins: np.ndarray, begin: np.ndarray | None = None) -> np.ndarray:
        """The leaf of every point, from the root or from the nodes that hold the points so far."""
        axis, cut, left = np.array(self.axis), np.array(self.cut), np.array(self.left)
        at = np.zeros(len(bins), dtype=np.int64) if begin is None else begin.copy()
        moving = np.flatnonzero(axis[at] >= 0)
        while len(moving):
            here = at[moving]
            at[moving] = left[here] + (bins[moving, axis[here]] > cut[here])
            moving = moving[axis[at[moving]] >= 0]
        return at


#: Nodes whose splits are weighed together.
TOGETHER = 256


def best_splits(histograms: np.ndarray, depths: Sequence[int], rule: Boosting) -> list[Leaf]:
    """Leaves with the split of the largest gain, the first of equal ones; none below the least rows or without gain."""
    made = []
    for begin in range(0, len(histograms), TOGETHER):
        here = histograms[begin : begin + TOGETHER]
        sums = here[:, 0].sum(axis=1)
        left = np.cumsum(here, axis=2)[:, :, :-1]
        right = sums[:, None, None] - left
        ok = (left[..., 0] >= rule.min_leaf) & (right[..., 0] >= rule.min_leaf) & (left[..., 1] > 1e-3) & (right[..., 1] > 1e-3)
        with np.errstate(divide="ignore", invalid="ignore"):
            whole = sums[:, 2] ** 2 / (sums[:, 1] + rule.l2)
            gain = left[..., 2] ** 2 / (left[..., 1] + rule.l2) + right[..., 2] ** 2 / (right[..., 1] + rule.l2) - whole[:, None, None]
        gain = np.where(ok, gain, -np.inf).reshape(len(here), -1)
        if not gain.shape[1]:
            gain = np.full((len(here), 1), -np.inf)
        place = gain.argmax(axis=1)
        best = gain[np.arange(len(here)), place]
        axis, cut = np.divmod(place, max(left.shape[2], 1))
        # sums of children are differences, so what is only rounding is no gain
        splits = np.isfinite(best) & (best > 1e-12 * (1.0 + whole))
        if rule.max_depth is not None:
            splits &= np.asarray(depths[begin : begin + TOGETHER]) < rule.max_depth
        rows = left[..., 0].reshape(len(here), -1)
        small = np.where(rows[np.arange(len(here)), place] <= sums[:, 0] - rows[np.arange(len(here)), place], 0, 1) if rows.shape[1] else np.zeros(len(here), dtype=int)
        for i, (open_, a, c, g, k) in enumerate(zip(splits.tolist(), axis.tolist(), cut.tolist(), best.tolist(), small.tolist(), strict=True)):
            # only a leaf that can split needs its histogram
            made.append(Leaf(sums[i], here[i], depths[begin + i], a, c, g, k) if open_ else Leaf(sums[i], None, depths[begin + i]))
    return made


def _first_splits(leaves: list[Leaf], rule: Boosting) -> tuple[list[int], list[int]]:
    """What best-first growth splits, as far as gains are known, and which of it has no children yet."""
    heap, chosen, unknown = [], [], []
    if leaves[0].axis >= 0:
        heap.append((-leaves[0].gain, 0))
    while heap and len(chosen) < rule.max_leaves - 1:
        _, at = heapq.heappop(heap)
        chosen.append(at)
        if leaves[at].children is None:
            unknown.append(at)
            continue
        for child in leaves[at].children:
            if leaves[child].axis >= 0:
                heapq.heappush(heap, (-leaves[child].gain, child))
    return chosen, unknown


def grow_tree(histograms, rule: Boosting) -> tuple[Tree, np.ndarray]:
    """One tree by best-first growth, and the gain of each feature.

    ``histograms(tree, nodes)`` gives (nodes, features, bins, sums) over the points that stand in these leaves of ``tree``.
    """
    opened = Tree()
    first = histograms(opened, [0])[0]
    leaves = best_splits(first[None], [0], rule)
    able, bound = int(leaves[0].axis >= 0), False
    fresh = [0] * able
    while True:
        if able < rule.max_leaves:
            chosen, unknown, fresh = [], fresh, []  # the bound on leaves decides nothing yet
        else:
            chosen, unknown = _first_splits(leaves, rule)
            bound = True
        if not unknown:
            break
        wanted = []
        for at in unknown:
            here = leaves[at]
            here.children = (len(opened.axis), len(opened.axis) + 1)
            opened.axis[at], opened.cut[at], opened.left[at] = here.axis, here.cut, here.children[0]
            for column, blank in ((opened.axis, -1), (opened.cut, 0), (opened.left, 0), (opened.value, 0.0)):
                column += [blank, blank]
            wanted.append(here.children[here.small])
        pairs, depths = np.empty((2 * len(unknown), *first.shape)), []
        for i, (at, found) in enumerate(zip(unknown, histograms(opened, wanted), strict=True)):
            here = leaves[at]
            pairs[2 * i + here.small] = found
            np.subtract(here.histogram, found, out=pairs[2 * i + 1 - here.small])
            here.histogram = None
            depths += [here.depth + 1] * 2
        begin = len(leaves)
        leaves += best_splits(pairs, depths, rule)
        fresh += [k for k in range(begin, len(leaves)) if leaves[k].axis >= 0]
        able += len(fresh)
    tree, gains = Tree(), np.zeros(first.shape[0])
    if not bound:  # every split counts, and children were numbered in the order of their parents
        sums, axis = np.array([x.sums for x in leaves]), np.array(opened.axis)
        weight = sums[:, 1] + rule.l2
        with np.errstate(divide="ignore", invalid="ignore"):
            opened.value = np.where((axis < 0) & (weight != 0), -rule.rate * sums[:, 2] / weight, 0.0).tolist()
        np.add.at(gains, axis[axis >= 0], [x.gain for x in leaves if x.axis >= 0])
        return opened, gains
    places, split = {0: 0}, set(chosen)
    order = [0]
    for at in order:  # grows while it is read
        here, place = leaves[at], places[at]
        if at in split:
            gains[here.axis] += here.gain
            tree.axis[place], tree.cut[place], tree.left[place] = here.axis, here.cut, len(tree.axis)
            for child in here.children:
                places[child] = len(tree.axis)
                for column, blank in ((tree.axis, -1), (tree.cut, 0), (tree.left, 0), (tree.value, 0.0)):
                    column.append(blank)
                order.append(child)
        else:
            tree.value[place] = -rule.rate * here.sums[2] / (here.sums[1] + rule.l2) if here.sums[1] + rule.l2 else 0.0
    return tree, gains


def _histogram(bins: np.ndarray, leaf: np.ndarray, nodes: Sequence[int], values: np.ndarray, size: int) -> np.ndarray:
    """(nodes, features, bins, sums) of the points in the given leaves."""
    place = np.full(max(int(leaf.max(initial=0)), *nodes, 0) + 1, -1, dtype=np.int64)
    place[list(nodes)] = np.arange(len(nodes))
    held = place[leaf]
    at = np.flatnonzero(held >= 0)
    cells, values = held[at] * size, values[at]
    made = np.empty((len(nodes), bins.shape[1], size, values.shape[1]))
    for f in range(bins.shape[1]):
        cell = cells + bins[at, f]
        for k in range(values.shape[1]):
            made[:, f, :, k] = np.bincount(cell, weights=values[:, k], minlength=len(nodes) * size).reshape(len(nodes), size)
    return made


def _part(number: int, tree: Tree, gains: np.ndarray, edges: Sequence[np.ndarray]) -> pd.DataFrame:
    cut = [float(edges[a][c]) if a >= 0 else v for a, c, v in zip(tree.axis, tree.cut, tree.value, strict=True)]
    part = {"axis": np.array(tree.axis), "left": np.array(tree.left), "number": np.array(cut)}
    return pd.DataFrame({"tree": [number], "path": [""], "root": [True], **_binary(part), "jump": [None], "gain": [gains.tolist()]})


def bin_edges(rows: DataFrame, names: Sequence[str], bins: int = 255) -> list[np.ndarray]:
    """Upper ends of the bins of every feature: midpoints of few values, else quantiles."""
    made = []
    for c in names:
        found = rows.select(c).distinct().limit(bins + 1).collect()  # bounded by the limit
        if len(found) <= bins:
            values = np.sort(np.array([r[0] for r in found], dtype=float))
            made.append((values[:-1] + values[1:]) / 2)
        else:
            shares = [i / bins for i in range(1, bins)]
            made.append(np.unique(np.array(one_row(rows, F.percentile_approx(c, shares, 10 * bins).alias("q"))["q"], dtype=float)))
    return made


def binned_points(rows: DataFrame, names: Sequence[str], edges: Sequence[np.ndarray], label: str, weight: Column, groups: int = 1) -> tuple[DataFrame, float]:
    """Points of equal bins (b0, b1, ...) and group (k) with n, w, s (around the weighted mean of the target), and that mean."""
    middle = float(one_row(rows, (F.sum(weight * F.col(label)) / F.sum(weight)).alias("m"))["m"] or 0.0)
    places = [f"b{i}" for i in range(len(names))]

    def to_bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = {b: np.searchsorted(edge, batch[f"x{i}"].to_numpy(float)).astype(np.int32) for i, (b, edge) in enumerate(zip(places, edges, strict=True))}
            yield pd.DataFrame({**made, "k": batch["k"], "n": batch["n"], "w": batch["w"], "s": batch["s"]})

    values = [F.col(c).alias(f"x{i}") for i, c in enumerate(names)]
    group = F.pmod(F.xxhash64(*names, label), F.lit(groups)).cast("int").alias("k")
    summed = rows.groupBy(*values, group).agg(F.count("*").alias("n"), F.sum(weight).alias("w"), F.sum(weight * (F.col(label) - F.lit(middle))).alias("s"))
    schema = ", ".join([f"{b} int" for b in places]) + ", k int, n long, w double, s double"
    points = summed.mapInPandas(to_bins, schema).groupBy(*places, "k").agg(*[F.sum(c).alias(c) for c in ("n", "w", "s")])
    return points.filter("w > 0"), middle


def boost_here(frame: pd.DataFrame, rule: Boosting, edges: Sequence[np.ndarray]) -> pd.DataFrame:
    """All rounds over points that fit one task."""
    places = [f"b{i}" for i in range(len(edges))]
    frame = frame.sort_values([*places, "k"], ignore_index=True)
    whole, n, w, s = frame[places].to_numpy(), *(frame[c].to_numpy(float) for c in ("n", "w", "s"))
    group, size = frame["k"].to_numpy(), max((len(e) for e in edges), default=0) + 1
    # groups of equal bins stand in the same leaf of every tree, and share their prediction
    new = np.flatnonzero(np.concatenate(([True], (whole[1:] != whole[:-1]).any(axis=1)))) if len(whole) else np.empty(0, dtype=int)
    bins, cell = whole[new], np.repeat(np.arange(len(new)), np.diff(np.append(new, len(whole))))
    predicted, made = np.zeros(len(bins)), []
    for number in range(rule.rounds):
        taken = np.flatnonzero(rule.takes(number, group))
        own, places_now = cell[taken], whole[taken]
        values = np.stack([n[taken], w[taken], w[taken] * predicted[own] - s[taken]], axis=1)
        at = np.zeros(len(bins), dtype=np.int64)

        def counted(tree: Tree, nodes: Sequence[int], values=values, at=at, own=own, places_now=places_now) -> np.ndarray:
            at[:] = tree.leaf(bins, at)  # the tree only grows below its leaves
            return _histogram(places_now, at[own], nodes, values, size)

        tree, gains = grow_tree(counted, rule)
        predicted += np.array(tree.value)[tree.leaf(bins)]
        made.append(_part(number, tree, gains, edges))
    return pd.concat(made, ignore_index=True) if made else pd.DataFrame()


def boost_apart(points: DataFrame, rule: Boosting, edges: Sequence[np.ndarray]) -> pd.DataFrame:
    """All rounds with every histogram summed over the cluster; the driver holds histograms and trees only."""
    places, size = [f"b{i}" for i in range(len(edges))], max((len(e) for e in edges), default=0) + 1
    held, recent, made = points.withColumn("p", F.lit(0.0)).checkpoint(), [], []

    def later(p: np.ndarray, bins: np.ndarray, trees: Sequence[Tree]) -> np.ndarray:
        for tree in trees:
            p = p + np.array(tree.value)[tree.leaf(bins)]
        return p

    def histograms(tree: Tree, nodes: Sequence[int]) -> np.ndarray:
        known, number = list(recent), len(made)

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(nodes), len(places), size, len(SUMS)))
            for batch in batches:
                bins, n, w, s, p = batch[places].to_numpy(), *(batch[c].to_numpy(float) for c in ("n", "w", "s", "p"))
                values = np.stack([n, w, w * later(p, bins, known) - s], axis=1) * rule.takes(number, batch["k"].to_numpy())[:, None]
                total += _histogram(bins, tree.leaf(bins), nodes, values, size)
            at = np.argwhere(total[..., 0] > 0)
            yield pd.DataFrame({**{c: at[:, i] for i, c in enumerate(("node", "f", "b"))}, **{c: total[..., i][tuple(at.T)] for i, c in enumerate(SUMS)}})

        sums = held.mapInPandas(count, "node int, f int, b int, n double, h double, g double").groupBy("node", "f", "b").agg(*[F.sum(c).alias(c) for c in SUMS])
        found = np.zeros((len(nodes), len(places), size, len(SUMS)))
        for row in sums.collect():  # leaves x features x bins
            found[row["node"], row["f"], row["b"]] = [row[c] for c in SUMS]
        return found

    for number in range(rule.rounds):
        tree, gains = grow_tree(histograms, rule)
        made.append(_part(number, tree, gains, edges))
        recent.append(tree)
        if len(recent) == KEPT_ROUNDS:
            known = list(recent)

            def keep(batches: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    yield batch.assign(p=later(batch["p"].to_numpy(float), batch[places].to_numpy(), known))

            held, recent = held.mapInPandas(keep, held.schema).checkpoint(), []
    return pd.concat(made, ignore_index=True) if made else pd.DataFrame()


def fit_boosting(rows: DataFrame, names: Sequence[str], label: str, weight: Column, rule: Boosting, bins: int = 255, here: int = HERE_POINTS) -> tuple[DataFrame, float]:
    """The trees as parts that ``trees.forest_sums`` scores, and the mean they start from."""
    spark = rows.sparkSession
    work_dir(spark)
    edges = bin_edges(rows, names, bins)
    points, middle = binned_points(rows, names, edges, label, weight, GROUPS if rule.subsample < 1 else 1)
    points = points.checkpoint()
    if points.count() <= here:
        parts = points.groupBy(F.lit(0).alias("all")).applyInPandas(lambda frame: boost_here(frame, rule, edges), PART)
    else:
        made = boost_apart(points, rule, edges)
        parts = spark.createDataFrame(made.astype(object).where(made.notna(), None).values.tolist(), PART) if len(made) else spark.createDataFrame([], PART)
    path = scratch_path(spark, "boosted")
    parts.write.parquet(path)
    return spark.read.schema(PART).parquet(path), middle
