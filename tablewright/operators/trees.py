"""Forests over tables of any size: extremely randomised trees and random forests.

Equal feature rows become one point with its number of rows, weight, sum and sum of squares of the target; a random forest
has points of its own for every tree, from rows drawn with replacement.  All trees grow together: every level is two
aggregates over the points, one for the minima, maxima and moments of each node, one for the moments left of the candidate
thresholds.  Extremely randomised trees draw one threshold between minimum and maximum of a feature, random forests take the
best of a feature's bins.  A node that is down to a part's points is finished inside one task by the same rule, there with
every threshold between two values as a candidate.  A fitted forest is a table of parts, and scoring joins blocks of points
with blocks of trees.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.columns import one_row
from tablewright.operators.density import SENT_NODES
from tablewright.session import scratch_path, work_dir

#: Points that one task finishes alone, trees that are scored together, points of a scoring block.
PART_POINTS, TREES_TOGETHER, BLOCK_POINTS = 20_000, 16, 32_768
#: Rows that a task draws for all trees at once.
DRAWN_ROWS = 32_768
MOMENTS = ["n", "w", "s", "q"]
PART = "tree int, path string, root boolean, axis binary, left binary, number binary, jump array<string>, gain array<double>"


@dataclass(frozen=True)
class Growth:
    """What bounds a tree."""

    max_depth: int | None
    min_split: int
    min_leaf: int
    max_features: int
    seed: int
    best: bool = False

    def may_split(self, depth: int, n: np.ndarray, w: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = q - s * s / w
        open_ = (n >= max(self.min_split, 2 * self.min_leaf)) & (spread > 1e-12 * np.maximum(q, 1e-300))
        return open_ if self.max_depth is None or depth < self.max_depth else np.zeros(len(n), dtype=bool)

    def draw(self, rng: np.random.Generator, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A threshold between minimum and maximum of every feature of every node, and the order in which features are drawn."""
        cut = low + rng.random(low.shape) * (high - low)
        cut = np.where(cut >= high, low, cut)
        order = np.where(low < high, rng.random(low.shape), np.inf)
        return cut, order

    def gains(self, left: dict[str, np.ndarray], all_: dict[str, np.ndarray]) -> np.ndarray:
        """What the squared error falls by; minus infinity where a side is too small."""
        n, w, s = (all_[m][:, None] for m in ("n", "w", "s"))
        ok = (left["n"] >= self.min_leaf) & (n - left["n"] >= self.min_leaf) & (left["w"] > 0) & (w - left["w"] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left["s"] ** 2 / left["w"] + (s - left["s"]) ** 2 / (w - left["w"]) - s * s / w
        return np.where(ok, gain, -np.inf)

    def pick(self, order: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best of the features drawn first, or the first valid one after them; -1 where none is.  And its gain."""
        ok = np.isfinite(order) & np.isfinite(gain)
        place = np.argsort(np.argsort(order, axis=1, kind="stable"), axis=1)
        first = ok & (place < self.max_features)
        later = ok & (place == np.where(ok, place, order.shape[1]).min(axis=1)[:, None])
        gain = np.where(np.where(first.any(axis=1)[:, None], first, later), gain, -np.inf)
        axis = gain.argmax(axis=1)
        best = gain[np.arange(len(axis)), axis]
        return np.where(np.isfinite(best), axis, -1), np.where(np.isfinite(best), np.maximum(best, 0.0), 0.0)

    def choose(self, order: np.ndarray, left: dict[str, np.ndarray], all_: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return self.pick(order, self.gains(left, all_))


def best_cuts(rows: np.ndarray, node: np.ndarray, begin: np.ndarray, moments: dict[str, np.ndarray], here: dict[str, np.ndarray], rule: Growth, ranks: Sequence[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For every node and feature the best threshold between two neighbouring values, and its gain.

    ``rows`` are sorted by ``node``, which starts at ``begin``; ``ranks`` are their places by node and value of each feature."""
    cut, gain = np.zeros((len(begin), rows.shape[1])), np.full((len(begin), rows.shape[1]), -np.inf)
    used = {m: moments[m] for m in ("n", "w", "s")}
    before = {m: np.concatenate(([0.0], np.cumsum(v)))[begin] for m, v in used.items()}
    for axis in range(rows.shape[1]):
        order = ranks[axis] if ranks is not None else np.lexsort((rows[:, axis], node))
        value = rows[order, axis]  # the places of a node stay where its rows are, so ``node`` is the owner
        at = np.flatnonzero((node[1:] == node[:-1]) & (value[1:] > value[:-1]))
        if not len(at):
            continue
        owner = node[at]
        left = {m: (np.cumsum(v[order])[at] - before[m][owner])[:, None] for m, v in used.items()}
        found = rule.gains(left, {m: here[m][owner] for m in used})[:, 0]
        found = np.where(np.isnan(found), -np.inf, found)
        # the first of the largest gains of each node
        group = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        most = np.repeat(np.maximum.reduceat(found, group), np.diff(np.append(group, len(at))))
        top = np.flatnonzero(found == most)
        first = top[np.concatenate(([True], owner[top][1:] != owner[top][:-1]))]
        k, middle = at[first], (value[at[first]] + value[at[first] + 1]) / 2
        cut[node[k], axis] = np.where(middle < value[k + 1], middle, value[k])
        gain[node[k], axis] = found[first]
    return cut, gain


def node_rng(seed: int, tree: int, path: str) -> np.random.Generator:
    return np.random.default_rng([seed, tree, zlib.crc32(path.encode())])


def _by_number(number: np.ndarray, most: int) -> np.ndarray:
    """The stable order of small numbers; short ones are counted instead of compared."""
    return np.argsort(number.astype(np.uint16) if most <= 1 << 16 else number, kind="stable")


def grow_part(x: np.ndarray, moments: dict[str, np.ndarray], rule: Growth, depth: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """A whole tree over some points, level by level: axis (-1 in leaves), left child (the right one follows), cut or value."""
    axis, left, number, made = [], [], [], 0  # levels
    gain = np.zeros(x.shape[1])
    members = np.arange(len(x))
    node = np.zeros(len(x), dtype=np.int64)  # place of each member's node in its level; members are sorted by it
    ranks = [np.argsort(x[:, f], kind="stable") for f in range(x.shape[1])] if rule.best else None
    while len(members):
        begin = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        rows, held = x[members], {m: v[members] for m, v in moments.items()}
        here = {m: np.add.reduceat(v, begin) for m, v in held.items()}
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(here["w"] != 0, here["s"] / here["w"], 0.0)
        cut, drawn = rule.draw(rng, np.minimum.reduceat(rows, begin, axis=0), np.maximum.reduceat(rows, begin, axis=0))
        if rule.best:
            cut, gains = best_cuts(rows, node, begin, held, here, rule, ranks)
            best, won = rule.pick(drawn, gains)
        else:
            goes_left = rows <= cut[node]
            side = {m: np.add.reduceat(np.where(goes_left, held[m][:, None], 0.0), begin, axis=0) for m in ("n", "w", "s")}
            best, won = rule.choose(drawn, side, here)
        split = rule.may_split(depth, *(here[m] for m in MOMENTS)) & (best >= 0)
        np.add.at(gain, best[split], won[split])
        count = 2 * int(split.sum())
        child = np.full(len(begin), -1, dtype=np.int64)
        child[split] = np.arange(count // 2) * 2
        made += len(begin)
        axis.append(np.where(split, best, -1))
        left.append(np.where(split, made + child, 0))
        number.append(np.where(split, cut[np.arange(len(begin)), best], value))
        on = np.flatnonzero(split[node])
        at = node[on]
        into = child[at] + (rows[on, best[at]] > cut[at, best[at]])
        order = _by_number(into, count)
        members, depth = members[on][order], depth + 1
        if ranks is not None:
            kept = np.full(len(node), -1, dtype=np.int64)
            kept[on] = np.arange(len(on))
            place = np.empty(len(on), dtype=np.int64)
            place[order] = np.arange(len(on))
            for f, ranked in enumerate(ranks):
                still = kept[ranked]
                still = still[still >= 0]
                ranks[f] = place[still[_by_number(into[still], count)]]
        node = into[order]
    return {"axis": np.concatenate(axis).astype(np.int32), "left": np.concatenate(left).astype(np.int32), "number": np.concatenate(number), "gain": gain}


def walk(part: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The leaf of every row."""
    at = np.zeros(len(x), dtype=np.int64)
    moving = np.flatnonzero(part["axis"][at] >= 0)
    while len(moving):
        here = at[moving]
        axis = part["axis"][here]
        at[moving] = part["left"][here] + (x[moving, axis] > part["number"][here])
        moving = moving[part["axis"][at[moving]] >= 0]
    return at


def points_of(rows: DataFrame, names: Sequence[str], label: str, weight: Column) -> tuple[DataFrame, float]:
    """Distinct feature rows with their moments around the weighted mean of the target, and that mean."""
    facts = one_row(rows, (F.sum(weight * F.col(label)) / F.sum(weight)).alias("m"))
    middle = float(facts["m"] or 0.0)
    apart = F.col(label) - F.lit(middle)
    made = rows.groupBy(*[(F.col(c) + 0.0).alias(c) for c in names]).agg(
        F.count("*").alias("n"), F.sum(weight).alias("w"), F.sum(weight * apart).alias("s"), F.sum(weight * apart * apart).alias("q")
    )
    return made.filter(F.col("w") > 0), middle


def _hashes(seed: int, tree: int, row: np.ndarray) -> np.ndarray:
    """``xxhash64(seed, tree, row)`` of each row."""
    one, two, three, four, five = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        low = x >> np.uint64(64 - by)
        x <<= np.uint64(by)
        x |= low
        return x

    def mixed(h: np.ndarray) -> np.ndarray:
        h ^= h >> np.uint64(33)
        h *= two
        h ^= h >> np.uint64(29)
        h *= three
        h ^= h >> np.uint64(32)
        return h

    h = np.full(1, 42, dtype=np.uint64)
    for number in (seed, tree):
        h = mixed(turned((h + five + np.uint64(4)) ^ (np.full(1, number & 0xFFFFFFFF, dtype=np.uint64) * one), 23) * two + three)
    own = turned(row.view(np.uint64) * two, 31)
    own *= one
    own ^= h + five + np.uint64(8)
    own = turned(own, 27)
    own *= one
    own += four
    return mixed(own)


def chances(seed: int, tree: int, row: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each row of a tree: the low 52 bits of ``xxhash64(seed, tree, row)``."""
    return (_hashes(seed, tree, row) & np.uint64((1 << 52) - 1)) / float(1 << 52)


#: Ends of the chances of no, one, two, ... times; the times by the first twelve bits of a chance, but where an end lies between.
ENDS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
TIMES = np.searchsorted(ENDS, np.arange(1 << 12) / (1 << 12), side="right").astype(float)
CUT = np.isin(np.arange(1 << 12), np.minimum(ENDS * (1 << 12), (1 << 12) - 1).astype(int))


def times_drawn(seed: int, tree: int, row: np.ndarray) -> np.ndarray:
    """How often each row comes up in a tree: a Poisson variable of mean one."""
    h = _hashes(seed, tree, row)
    bits = ((h >> np.uint64(40)) & np.uint64((1 << 12) - 1)).astype(np.int64)
    times, near = TIMES[bits], np.flatnonzero(CUT[bits])
    times[near] = np.searchsorted(ENDS, (h[near] & np.uint64((1 << 52) - 1)) / float(1 << 52), side="right")
    return times


def _dealt(rows: DataFrame, names: Sequence[str], label: str, weight: Column) -> tuple[DataFrame, float]:
    """Numbered rows around the weighted mean of the target, equal ones side by side, and that mean.

    Equal rows lie together, so a draw gives few points, and a point with many rows is cut by their numbers."""
    spark = rows.sparkSession
    middle = float(one_row(rows, (F.sum(weight * F.col(label)) / F.sum(weight)).alias("m"))["m"] or 0.0)
    numbered = rows.select(*[(F.col(c) + 0.0).alias(c) for c in names], (F.col(label) - F.lit(middle)).alias("_y"), weight.alias("_w"), F.monotonically_increasing_id().alias("_row")).checkpoint()
    dealt = numbered.repartitionByRange(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *names, "_row")
    return dealt.sortWithinPartitions(*names), middle


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += len(batch)
        if size >= DRAWN_ROWS:
            yield pd.concat(waiting, ignore_index=True)
            waiting, size = [], 0
    if size:
        yield pd.concat(waiting, ignore_index=True)


def _draws(chunk: pd.DataFrame, names: Sequence[str], trees: int, seed: int) -> tuple[np.ndarray, Iterator[tuple[int, np.ndarray]]]:
    """The points of a chunk, and for every tree their moments."""
    point = chunk.groupby(list(names), sort=False, dropna=False).ngroup().to_numpy()
    first = np.flatnonzero(np.concatenate(([True], point[1:] != point[:-1])))
    row, y, w = chunk["_row"].to_numpy(np.int64), chunk["_y"].to_numpy(float), np.nan_to_num(chunk["_w"].to_numpy(float))
    wy = w * y
    parts = [w, wy, wy * y]

    def drawn() -> Iterator[tuple[int, np.ndarray]]:
        for tree in range(trees):
            times = times_drawn(seed, tree, row)
            yield tree, np.stack([np.add.reduceat(v, first) for v in ((times > 0).astype(float), *[times * p for p in parts])], axis=1)

    return chunk[list(names)].to_numpy(float)[first], drawn()


def drawn_blocks(rows: DataFrame, names: Sequence[str], label: str, weight: Column, trees: int, seed: int) -> tuple[DataFrame, float]:
    """``drawn_points`` as packed blocks (tree, block) of features and moments; a point can stand in several blocks."""
    dealt, middle = _dealt(rows, names, label, weight)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _chunks(batches):
            at, drawn = _draws(chunk, names, trees, seed)
            held, size = [], 0
            for tree, moments in drawn:
                came = moments[:, 0] > 0
                held.append((tree, np.concatenate([at[came], moments[came]], axis=1).tobytes()))
                size += int(came.sum())
                if size >= BLOCK_POINTS:
                    yield pd.DataFrame(held, columns=["tree", "block"])
                    held, size = [], 0
            if held:
                yield pd.DataFrame(held, columns=["tree", "block"])

    return dealt.mapInPandas(draw, "tree int, block binary"), middle


def drawn_points(rows: DataFrame, names: Sequence[str], label: str, weight: Column, trees: int, seed: int) -> tuple[DataFrame, float]:
    """Points of every tree (column ``tree``) from rows drawn with replacement, and the mean the target is taken around.

    A row comes up in a tree as often as a Poisson variable of mean one says, the limit of drawing as many rows as there are;
    ``n`` counts rows that came up."""
    dealt, middle = _dealt(rows, names, label, weight)
    names = list(names)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _chunks(batches):
            at, drawn = _draws(chunk, names, trees, seed)
            held, size = [], 0
            for tree, moments in drawn:
                came = moments[:, 0] > 0
                made = pd.DataFrame(np.concatenate([at[came], moments[came]], axis=1), columns=[*names, *MOMENTS])
                held.append(made.assign(tree=np.int32(tree), n=made["n"].astype(np.int64)))
                size += int(came.sum())
                if size >= BLOCK_POINTS:
                    yield pd.concat(held, ignore_index=True)
                    held, size = [], 0
            if held:
                yield pd.concat(held, ignore_index=True)

    schema = ", ".join([*[f"`{c}` double" for c in names], "tree int, n long, w double, s double, q double"])
    made = dealt.mapInPandas(draw, schema).groupBy("tree", *names).agg(*[F.sum(m).alias(m) for m in MOMENTS])
    return made.filter(F.col("w") > 0), middle


#: Bins of a feature whose ends are the candidates of nodes above the parts.
UPPER_BINS = 64


def _below(name: str):
    return lambda end: end < F.col(name)


def _best_of_bins(work: DataFrame, drawn: DataFrame, names: Sequence[str], edges: Sequence[Sequence[float]], rule: Growth, send) -> DataFrame:
    """The nodes above the parts of a random forest: histograms of all features, the best bin end of the drawn ones."""
    bins = [F.size(F.filter(F.array(*[F.lit(float(e)) for e in ends]), _below(c))) if len(ends) else F.lit(0) for c, ends in zip(names, edges, strict=True)]
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), b.alias("b")) for i, b in enumerate(bins)])).alias("place")
    aimed = work.join(send(drawn.select("tree", "path")), ["tree", "path"]).select("tree", "path", *MOMENTS, places)
    sums = aimed.groupBy("tree", "path", "place.f", "place.b").agg(*[F.sum(F.col(m).cast("double")).alias(m) for m in MOMENTS])

    def choose(key, histogram: pd.DataFrame, node: pd.DataFrame) -> pd.DataFrame:
        if not len(node):
            return pd.DataFrame({"tree": [], "path": [], "axis": [], "cut": [], "gain": []})
        here = {m: node[m].to_numpy() for m in MOMENTS}
        gain, cut = np.full((1, len(names)), -np.inf), np.zeros(len(names))
        for f, part in histogram.sort_values("b").groupby("f"):
            if not len(edges[f]):
                continue
            left = {m: part[m].cumsum().to_numpy()[:-1][None, :] for m in MOMENTS}
            if left["n"].shape[1]:
                found = rule.gains(left, here)[0]
                gain[0, f], cut[f] = found.max(), edges[f][int(part["b"].iloc[int(found.argmax())])]
        best, won = rule.pick(np.stack(node["drawn"].to_list()), gain)
        split = bool(best[0] >= 0 and rule.may_split(len(key[1]), *(here[m] for m in MOMENTS))[0])
        value = float(here["s"][0] / here["w"][0])
        return pd.DataFrame({"tree": [key[0]], "path": [key[1]], "axis": [int(best[0]) if split else -1], "cut": [float(cut[best[0]]) if split else value], "gain": [float(won[0]) if split else 0.0]})

    return sums.groupBy("tree", "path").cogroup(drawn.groupBy("tree", "path")).applyInPandas(choose, "tree int, path string, axis int, cut double, gain double")


def _drawn_cuts(work: DataFrame, drawn: DataFrame, names: Sequence[str], choose, send) -> DataFrame:
    """The nodes above the parts of extremely randomised trees: the moments left of the drawn thresholds decide."""
    aimed = work.join(send(drawn.select("tree", "path", "cut")), ["tree", "path"])
    goes = [F.col(c) <= F.get("cut", F.lit(i)) for i, c in enumerate(names)]
    side = aimed.groupBy("tree", "path").agg(*[F.coalesce(F.sum(F.when(g, F.col(m).cast("double"))), F.lit(0.0)).alias(f"{m}{i}") for i, g in enumerate(goes) for m in MOMENTS])
    return drawn.join(side, ["tree", "path"]).mapInPandas(choose, "tree int, path string, axis int, cut double, gain double")


def _upper(points: DataFrame, names: Sequence[str], trees: int, rule: Growth, part_points: int) -> tuple[DataFrame, list[DataFrame]]:
    """The points of every tree with the path to their part, and the nodes above the parts, level by level."""
    width, levels, edges = len(names), [], None
    if "tree" not in points.columns:
        points = points.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    work = points.withColumn("path", F.lit("")).checkpoint()
    flat = ", ".join(f"{m} double" for m in MOMENTS)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            low, high = (batch[[f"{e}{i}" for i in range(width)]].to_numpy() for e in ("lo", "hi"))
            drawn = [rule.draw(node_rng(rule.seed, t, p), low[i : i + 1], high[i : i + 1]) for i, (t, p) in enumerate(zip(batch["tree"], batch["path"], strict=True))]
            yield batch[["tree", "path", *MOMENTS]].assign(cut=[c[0].tolist() for c, _ in drawn], drawn=[o[0].tolist() for _, o in drawn])

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            depth = batch["path"].str.len().iloc[0] if len(batch) else 0
            here = {m: batch[m].to_numpy() for m in MOMENTS}
            side = {m: batch[[f"{m}{i}" for i in range(width)]].to_numpy() for m in MOMENTS}
            best, gain = rule.choose(np.stack(batch["drawn"].to_list()), side, here) if len(batch) else (np.empty(0, dtype=int), np.empty(0))
            best = np.where(rule.may_split(depth, *(here[m] for m in MOMENTS)), best, -1)
            cut = np.stack(batch["cut"].to_list())[np.arange(len(best)), best] if len(batch) else np.empty(0)
            # a node that cannot be split is a leaf, and the number is its value
            number = np.where(best >= 0, cut, here["s"] / here["w"])
            yield batch[["tree", "path"]].assign(axis=best.astype(np.int32), cut=number, gain=np.where(best >= 0, gain, 0.0))

    while True:
        sums = [F.sum(F.col(m).cast("double")).alias(m) for m in MOMENTS]
        ends = [x for i, c in enumerate(names) for x in (F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"))]
        large = work.groupBy("tree", "path").agg(F.count("*").alias("points"), *sums, *ends).filter(F.col("points") > part_points)
        drawn = large.mapInPandas(draw, f"tree int, path string, {flat}, cut array<double>, drawn array<double>").checkpoint()
        count = drawn.count()
        if not count:
            return work, levels
        send = F.broadcast if count <= SENT_NODES else (lambda side: side)
        if rule.best:
            if edges is None:
                from tablewright.operators.boosting import bin_edges

                edges = [e.tolist() for e in bin_edges(work, names, UPPER_BINS)]
            nodes = _best_of_bins(work, drawn, names, edges, rule, send).checkpoint()
        else:
            nodes = _drawn_cuts(work, drawn, names, choose, send).checkpoint()
        levels.append(nodes)
        routed = work.join(send(nodes.select("tree", "path", "axis", "cut")), ["tree", "path"], "left")
        right = F.get(F.array(*names), F.col("axis")) > F.col("cut")
        routed = routed.withColumn("path", F.concat("path", F.when(F.col("axis").isNull(), "").when(right, "R").otherwise("L")))
        work = routed.filter("axis IS NULL OR axis >= 0").drop("axis", "cut").checkpoint()


def _binary(part: dict[str, np.ndarray]) -> dict[str, list]:
    return {"axis": [part["axis"].astype(np.int32).tobytes()], "left": [part["left"].astype(np.int32).tobytes()], "number": [part["number"].astype(np.float64).tobytes()]}


def _top(frame: pd.DataFrame, width: int) -> pd.DataFrame:
    """The nodes above the parts of one tree as a part of its own, whose leaves name the part that follows."""
    nodes = {p: (a, c) for p, a, c in zip(frame["path"], frame["axis"], frame["cut"], strict=True)}
    gain = np.zeros(width)
    np.add.at(gain, frame["axis"].to_numpy(), frame["gain"].to_numpy())  # leaves have none
    paths, axis, left, number, jump = [""], [], [], [], []
    for path in paths:  # grows while it is read
        a, c = nodes.get(path, (-1, 0.0))
        axis.append(a)
        number.append(c)
        left.append(len(paths) if a >= 0 else 0)
        jump.append(None if path in nodes else path)
        if a >= 0:
            paths += [path + "L", path + "R"]
    part = {"axis": np.array(axis), "left": np.array(left), "number": np.array(number)}
    return pd.DataFrame({"tree": frame["tree"].iloc[:1], "path": [""], "root": [True], **_binary(part), "jump": [jump], "gain": [gain.tolist()]})


def few_points(rows: DataFrame, names: Sequence[str], part_points: int = PART_POINTS) -> bool:
    """Whether one task can hold all distinct feature rows, by their sketch; a few too many do no harm."""
    return one_row(rows, F.approx_count_distinct(F.struct(*names)).alias("n"))["n"] <= 0.8 * part_points


def _points_of_blocks(blocks: Sequence[bytes], width: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Sorted points and their moments; parts of one point are added up."""
    whole = np.concatenate([np.frombuffer(b).reshape(-1, width + len(MOMENTS)) for b in blocks])
    whole = whole[np.lexsort(whole[:, :width].T[::-1])]
    x = whole[:, :width]
    new = (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1]))
    first = np.flatnonzero(np.concatenate(([True], new.any(axis=1)))) if len(x) else np.empty(0, dtype=int)
    sums = np.add.reduceat(whole[:, width:], first, axis=0) if len(x) else whole[:, width:]
    kept = sums[:, 1] > 0
    return x[first][kept], {m: np.ascontiguousarray(sums[kept, i]) for i, m in enumerate(MOMENTS)}


def _whole_tree(tree: int, x: np.ndarray, moments: dict[str, np.ndarray], rule: Growth) -> pd.DataFrame:
    part = grow_part(x, moments, rule, 0, node_rng(rule.seed, tree, "."))
    return pd.DataFrame({"tree": [tree], "path": [""], "root": [True], **_binary(part), "jump": [None], "gain": [part["gain"].tolist()]})


def _kept(parts: DataFrame) -> DataFrame:
    spark = parts.sparkSession
    work_dir(spark)
    path = scratch_path(spark, "forest")
    parts.write.parquet(path)
    return spark.read.schema(PART).parquet(path)


def fit_drawn(blocks: DataFrame, width: int, rule: Growth) -> DataFrame:
    """``fit_forest`` over the packed points of every tree, which one task holds."""

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        x, moments = _points_of_blocks(frame["block"], width)
        return _whole_tree(int(frame["tree"].iloc[0]), x, moments, rule) if len(x) else pd.DataFrame(columns=["tree", "path", "root", "axis", "left", "number", "jump", "gain"])

    return _kept(blocks.groupBy("tree").applyInPandas(grow, PART))


def _fit_alike(points: DataFrame, names: Sequence[str], trees: int, rule: Growth) -> DataFrame:
    """``fit_forest`` where all trees see the same points and one task holds them: they travel once for several trees."""
    width, columns = len(names), [*names, *MOMENTS]

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [np.ascontiguousarray(frame[columns].to_numpy(float)).tobytes()]})

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for some, block in zip(batch["trees"], batch["block"], strict=True):
                x, moments = _points_of_blocks([block], width)
                for tree in some:
                    yield _whole_tree(int(tree), x, moments, rule)

    spark = points.sparkSession
    packed = points.groupBy(F.lit(0).alias("all")).applyInPandas(pack, "block binary")
    number = F.col("id").cast("int")
    some = spark.range(0, trees, 1, 1).groupBy(F.floor(number / TREES_TOGETHER).alias("group")).agg(F.sort_array(F.collect_list(number)).alias("trees"))
    tasks = some.repartition(max(1, -(-trees // TREES_TOGETHER)), "group").crossJoin(F.broadcast(packed))
    return _kept(tasks.select("trees", "block").mapInPandas(grow, PART))


def fit_forest(points: DataFrame, names: Sequence[str], trees: int, rule: Growth, part_points: int = PART_POINTS) -> DataFrame:
    """The parts of all trees over ``points`` (features and moments), written to the shared folder."""
    width = len(names)
    work_dir(points.sparkSession)
    own = ["tree"] if "tree" in points.columns else []
    if not own:
        points = points.select(*names, *MOMENTS).checkpoint()
        if 0 < points.count() <= part_points:
            return _fit_alike(points, names, trees, rule)
    work, levels = _upper(points.select(*own, *names, *MOMENTS), names, trees, rule, part_points)
    below = bool(levels)

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(names), ignore_index=True)  # the same tree, however rows arrive
        tree, path = int(frame["tree"].iloc[0]), frame["path"].iloc[0]
        moments = {m: frame[m].to_numpy(float) for m in MOMENTS}
        part = grow_part(frame[list(names)].to_numpy(float), moments, rule, len(path), node_rng(rule.seed, tree, path + "."))
        return pd.DataFrame({"tree": [tree], "path": [path], "root": [not below], **_binary(part), "jump": [None], "gain": [part["gain"].tolist()]})

    parts = work.groupBy("tree", "path").applyInPandas(finish, PART)
    if below:
        nodes = levels[0]
        for level in levels[1:]:
            nodes = nodes.unionByName(level)
        parts = parts.unionByName(nodes.groupBy("tree").applyInPandas(lambda frame: _top(frame, width), PART))
    return _kept(parts)


def _read(raw) -> dict[str, np.ndarray]:
    return {"axis": np.frombuffer(raw["axis"], dtype=np.int32), "left": np.frombuffer(raw["left"], dtype=np.int32), "number": np.frombuffer(raw["number"])}


def forest_sums(points: DataFrame, parts: DataFrame, names: Sequence[str]) -> DataFrame:
    """Distinct feature rows with the sum of the leaf values of all trees (``total``)."""
    width = len(names)
    names = list(names)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.empty((0, width))
        for batch in batches:
            held = np.concatenate((held, batch[names].to_numpy(float)))
            while len(held) >= BLOCK_POINTS:
                yield pd.DataFrame({"block": [held[:BLOCK_POINTS].tobytes()]})
                held = held[BLOCK_POINTS:]
        if len(held):
            yield pd.DataFrame({"block": [held.tobytes()]})

    # no session setting is changed here: forests are scored side by side.  Spark bounds the bytes of a batch that goes to Python
    schema = ", ".join(f"`{c}` double" for c in names)
    blocks = points.select(*names).distinct().mapInPandas(pack, "block binary").checkpoint()
    group = F.floor(F.col("tree") / TREES_TOGETHER).cast("int").alias("group")
    roots = parts.filter("root").groupBy(group).agg(F.collect_list(F.struct("tree", "axis", "left", "number", "jump")).alias("trees"))
    last = one_row(parts, F.max("tree").alias("t"))["t"]
    groups = 0 if last is None else last // TREES_TOGETHER + 1

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair in batch.itertuples():
                x = np.frombuffer(pair.block).reshape(-1, width)
                total = np.zeros(len(x))
                made = pd.DataFrame(x, columns=names)
                for raw in pair.trees:
                    part = _read(raw)
                    at = walk(part, x)
                    if raw["jump"] is None:
                        total += part["number"][at]
                        continue
                    path = np.array([*raw["jump"], None], dtype=object)[at]
                    on = np.array([p is not None for p in path])
                    total[~on] += part["number"][at[~on]]
                    yield made[on].assign(total=0.0, tree=raw["tree"], path=path[on])
                yield made.assign(total=total, tree=-1, path="")

    copies = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))) if groups else blocks.withColumn("group", F.lit(0)).limit(0)
    first = copies.join(roots, "group").mapInPandas(score, f"{schema}, total double, tree int, path string").checkpoint()
    later = first.filter("tree >= 0")
    if later.isEmpty():
        every = first.select(*names, "total")
    else:
        lower = parts.filter("NOT root").select("tree", "path", "axis", "left", "number")
        # a path can hold most points: its points are cut by their hash
        slices = later.withColumn("slice", F.pmod(F.xxhash64(*names), F.lit(64)))
        packed = slices.groupBy("tree", "path", "slice").agg(F.collect_list(F.array(*names)).alias("rows"))

        def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for pair in batch.to_dict("records"):
                    x = np.stack(list(pair["rows"]))
                    part = _read(pair)
                    yield pd.DataFrame(x, columns=names).assign(total=part["number"][walk(part, x)])

        found = packed.join(lower, ["tree", "path"]).mapInPandas(finish, f"{schema}, total double")
        every = first.filter("tree < 0").select(*names, "total").unionByName(found)
    return every.groupBy(*names).agg(F.sum("total").alias("total")).checkpoint()


def importance(parts: DataFrame, names: Sequence[str]) -> list[float]:
    """Mean share of the gain of every feature over the trees."""
    places = [F.sum(F.get("gain", F.lit(i))).alias(f"g{i}") for i in range(len(names))]
    by_tree = parts.groupBy("tree").agg(*places).withColumn("all", sum((F.col(f"g{i}") for i in range(len(names))), F.lit(0.0)))
    row = one_row(by_tree.filter("all > 0"), *[F.avg(F.col(f"g{i}") / F.col("all")).alias(f"g{i}") for i in range(len(names))])
    return [float(row[f"g{i}"] or 0.0) for i in range(len(names))]


def features_drawn(setting: str | float | int | None, width: int) -> int:
    """How many features a split draws: "sqrt", "log2", a share, a number, or all."""
    if setting in (None, "all", 1.0):
        return width
    if setting in ("sqrt", "auto"):
        return max(1, int(math.sqrt(width)))
    if setting == "log2":
        return max(1, int(math.log2(width)))
    return max(1, int(setting * width) if isinstance(setting, float) else min(int(setting), width))


def load_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PART).parquet(path)
