"""Density clusters over any number of features, exact, in bounded tasks.

Distinct points are laid out in leaves of a split tree that grows level by level until no leaf holds more than a block of
points; every node keeps the box of its points.  Pairs of nodes descend the tree together: pairs farther apart than ``eps``
end there, pairs whose far corners are within ``eps`` are settled as a whole, and only pairs of leaves in between are compared
point by point, one pair of blocks at a time.  Counts, links between core points and touches of border points all follow
that plan; labels of different leaves are merged as connected components, first over settled pairs: leaves of core points
alone that are one component by then need no comparison, so dense regions cost no more than their points.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.ordinal import with_ordinal
from tablewright.session import scratch_path, work_dir

#: Children of a node: a complete binary tree of so many halvings.
HALVINGS = 5
#: Points of a leaf, and sampled points that decide the cuts of a node (never which points count).
LEAF_ROWS, SAMPLE_ROWS = 512, 4_096
#: Cuts of at most so many nodes (some 500 bytes each) are sent to all tasks; more nodes are joined by number.
SENT_NODES = 10_000
#: Pairs of blocks that go to Python at once.
PAIRS_AT_ONCE = 32


@contextlib.contextmanager
def _few_rows(spark: SparkSession, rows: int = PAIRS_AT_ONCE) -> Iterator[None]:
    """Rows that hold whole blocks travel in small batches, for the jobs that run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _written(df: DataFrame) -> DataFrame:
    """The rows from a table in the shared folder.  Unlike a checkpoint it does not carry on how all columns it came from were
    dealt and sorted, which makes the planning of repeated joins take longer round by round."""
    path = scratch_path(df.sparkSession, "density")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- layout -------------------------------------------------------------------------


def _cuts(points: np.ndarray, leaves: int) -> tuple[list[int], list[float]]:
    """Axis and cut of every inner node of a complete tree, medians along the widest axis; larger values go right."""
    axes, cuts = [0] * (2**HALVINGS - 1), [math.inf] * (2**HALVINGS - 1)

    def grow(at: int, rows: np.ndarray, share: int) -> None:
        spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(1)
        if at >= len(axes) or share <= 1 or not spread.max() > 0:
            return
        axis = int(np.argmax(spread))
        values = rows[:, axis]
        cut = float(np.median(values))
        if not (values > cut).any():
            cut = float(values[values < cut].max())
        axes[at], cuts[at] = axis, cut
        grow(2 * at + 1, rows[values <= cut], -(-share // 2))
        grow(2 * at + 2, rows[values > cut], share // 2)

    grow(0, points, leaves)
    return axes, cuts


def _laid_out(spots: DataFrame, leaf_rows: int) -> tuple[DataFrame, int]:
    """The points with their ``leaf``, and the depth of the tree.  Nodes above are ``leaf >> HALVINGS * steps``."""
    placed, depth = _written(spots.withColumn("leaf", F.lit(0).cast("long"))), 0

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        wanted = min(2**HALVINGS, max(2, math.ceil(1.5 * frame["n"].iloc[0] / leaf_rows)))
        axes, cuts = _cuts(np.stack(frame["point"].to_list()), wanted)
        return pd.DataFrame({"leaf": frame["leaf"].iloc[:1], "axes": [axes], "cuts": [cuts]})

    while True:
        large = _written(placed.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > leaf_rows))
        nodes = large.count()
        if not nodes:
            return placed, depth
        depth += 1
        send = F.broadcast if nodes <= SENT_NODES else (lambda side: side)
        share = F.lit(float(SAMPLE_ROWS)) / F.col("n") * (1 << 30)
        picked = placed.join(send(large), "leaf").filter(F.pmod(F.xxhash64("point", F.lit(depth)), F.lit(1 << 30)) < share)
        trees = _written(picked.select("leaf", "n", "point").groupBy("leaf").applyInPandas(grow, "leaf long, axes array<int>, cuts array<double>"))
        down = lambda at, _: 2 * at + 1 + (F.get("point", F.get("axes", at)) > F.get("cuts", at)).cast("int")
        child = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.lit(0), down) - (2**HALVINGS - 1)
        moved = placed.join(send(trees), "leaf", "left").withColumn("child", F.coalesce(F.when(F.col("axes").isNotNull(), child), F.lit(0)))
        placed = _written(moved.withColumn("leaf", F.col("leaf") * 2**HALVINGS + F.col("child")).select(*placed.columns))


def _above(leaf: str | Column, steps: int | Column) -> Column:
    column = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.floor(column / F.pow(F.lit(2.0), F.lit(HALVINGS) * steps)).cast("long")


def _ancestors(leaves: DataFrame, depth: int) -> DataFrame:
    """One row for each leaf and each node above it, the leaf itself included: level, node."""
    level = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    return leaves.withColumn("level", level).withColumn("node", _above("leaf", F.lit(depth) - F.col("level")))


def _nodes(placed: DataFrame, width: int, depth: int) -> DataFrame:
    """Level, node, rows and box of all nodes of the tree."""
    box = lambda name, of: [f(F.get(of, F.lit(i))).alias(f"{name}{i}") for i in range(width) for f in ((F.min if name == "lo" else F.max),)]
    packed = [F.array(*[F.col(f"{name}{i}") for i in range(width)]).alias(name) for name in ("lo", "hi")]
    leaves = placed.groupBy("leaf").agg(F.sum("rows").alias("rows"), *box("lo", "point"), *box("hi", "point")).select("leaf", "rows", *packed)
    every = _ancestors(leaves, depth).groupBy("level", "node").agg(F.sum("rows").alias("rows"), *box("lo", "lo"), *box("hi", "hi"))
    return _written(every.select("level", "node", "rows", *packed))


def _apart(nearest: bool) -> Column:
    """Squared distance of the boxes of ``a`` and ``b``: at least (nearest) or at most."""
    forth = F.zip_with("a_lo", "b_hi", lambda x, y: x - y)
    back = F.zip_with("b_lo", "a_hi", lambda x, y: x - y)
    side = (lambda x, y: F.greatest(x, y, F.lit(0.0))) if nearest else (lambda x, y: F.greatest(F.abs(x), F.abs(y)))
    return F.aggregate(F.zip_with(forth, back, side), F.lit(0.0), lambda total, x: total + x * x)


def _node_pairs(nodes: DataFrame, depth: int, eps: float) -> tuple[DataFrame, DataFrame]:
    """Pairs settled as a whole (level, a, b, a_rows, b_rows) and pairs of leaves to compare (a, b), a <= b."""
    sure: list[DataFrame] = []
    pairs = nodes.filter("level = 0").select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in range(depth + 1):
        here = nodes.filter(F.col("level") == level).drop("level")
        sides = [here.select(F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("rows", "lo", "hi")]) for s in ("a", "b")]
        judged = pairs.join(sides[0], "a").join(sides[1], "b").withColumns({"near": _apart(True), "far": _apart(False)})
        judged = _written(judged.filter(F.col("near") <= eps * eps).select("a", "b", "a_rows", "b_rows", "far"))
        sure.append(judged.filter(F.col("far") <= eps * eps).select(F.lit(level).alias("level"), "a", "b", "a_rows", "b_rows"))
        pairs = judged.filter(F.col("far") > eps * eps).select("a", "b")
        if level < depth:
            kids = nodes.filter(F.col("level") == level + 1).select("node", _above("node", F.lit(1)).alias("parent"))
            left = pairs.join(kids.select(F.col("node").alias("a_kid"), F.col("parent").alias("a")), "a")
            both = left.join(kids.select(F.col("node").alias("b_kid"), F.col("parent").alias("b")), "b")
            pairs = both.filter("a_kid <= b_kid").select(F.col("a_kid").alias("a"), F.col("b_kid").alias("b"))
    return reduce(DataFrame.unionByName, sure), pairs


def _both_ways(sure: DataFrame, value: str) -> DataFrame:
    """(level, node, value of the partner) for both nodes of each settled pair."""
    forth = sure.select("level", F.col("a").alias("node"), F.col(f"b_{value}").alias(value))
    back = sure.filter("a <> b").select("level", F.col("b").alias("node"), F.col(f"a_{value}").alias(value))
    return forth.unionByName(back)


# --- blocks -------------------------------------------------------------------------

BLOCK = "leaf long, given long, points binary, rows binary, keys binary"


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    """The points of a leaf as one row, by key."""
    points = np.stack(frame["point"].to_list())
    order = np.lexsort((*points.T[::-1], frame["key"].to_numpy()))
    return pd.DataFrame({
        "leaf": frame["leaf"].iloc[:1], "given": frame["given"].iloc[:1], "points": [points[order].tobytes()],
        "rows": [frame["rows"].to_numpy(np.int64)[order].tobytes()], "keys": [frame["key"].to_numpy(np.int64)[order].tobytes()],
    })


def _near(left: np.ndarray, right: np.ndarray, eps: float) -> np.ndarray:
    """Which points are within eps; axes are added one by one, as for boxes."""
    squared = np.zeros((len(left), len(right)))
    for axis in range(left.shape[1]):
        squared += (left[:, axis, None] - right[None, :, axis]) ** 2
    return squared <= eps * eps


def _points(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw).reshape(-1, width)


def _longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.int64)


def _groups(near: np.ndarray) -> np.ndarray:
    """The smallest member of each point's connected group, from an adjacency matrix."""
    label = np.arange(len(near))
    while len(near):
        least = np.where(near, label[None, :], len(near)).min(axis=1)
        least = np.minimum(least, label)
        least = np.minimum(least, least[least])
        if (least == label).all():
            break
        label = least
    return label


def _by_group(near: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every group of the rows, which columns any of its members is near to; rows without a group are left out."""
    order = np.argsort(groups, kind="stable")[np.count_nonzero(groups < 0) :]
    names, begin = np.unique(groups[order], return_index=True)
    made = np.logical_or.reduceat(near[order], begin, axis=0) if len(names) else np.zeros((0, near.shape[1]), dtype=bool)
    return made, names


def _dealt(pairs: DataFrame) -> DataFrame:
    """The pairs over all cores: few bytes stand for long comparisons."""
    spark = pairs.sparkSession
    return pairs.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "a", "b")


def _paired(pairs: DataFrame, blocks: DataFrame, columns: Sequence[str]) -> DataFrame:
    sides = [blocks.select(F.col("leaf").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in columns]) for s in ("a", "b")]
    return pairs.join(sides[0], "a").join(sides[1], "b")


def _counted(pairs: DataFrame, blocks: DataFrame, width: int, eps: float, least: int) -> DataFrame:
    """(leaf, i, n): rows within eps of each point, over the compared pairs of leaves that need it."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair in batch.itertuples():
                near = _near(_points(pair.a_points, width), _points(pair.b_points, width), eps)
                sides = [(pair.a, pair.a_given, near @ _longs(pair.b_rows))]
                if pair.a != pair.b:
                    sides.append((pair.b, pair.b_given, near.T @ _longs(pair.a_rows)))
                for leaf, given, n in sides:
                    at = np.flatnonzero(n)
                    if given < least and len(at):
                        yield pd.DataFrame({"leaf": leaf, "i": at.astype(np.int32), "n": n[at]})

    known = _paired(pairs, blocks.select("leaf", "given"), ["given"]).filter((F.col("a_given") < least) | (F.col("b_given") < least))
    wanted = _paired(_dealt(known.select("a", "b")), blocks, ["given", "points", "rows"])
    return wanted.mapInPandas(count, "leaf long, i int, n long").groupBy("leaf", "i").agg(F.sum("n").alias("n"))


LABELLED = "leaf long, points binary, keys binary, core binary, groups binary, cores int, others int, members array<long>"
#: A point's number: its leaf and its place there.
PLACES = 1 << 13


def _labelled(blocks: DataFrame, counts: DataFrame, width: int, eps: float, least: int) -> DataFrame:
    """Core points of each leaf and the groups they form inside it; a group is named by its first point."""

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in batch.itertuples():
                points = _points(block.points, width)
                n = np.full(len(points), block.given, dtype=np.int64)
                if block.counts is not None:
                    for found in block.counts:
                        n[found["i"]] += found["n"]
                core = n >= least
                at = np.flatnonzero(core)
                groups = np.full(len(points), -1, dtype=np.int64)
                groups[at] = block.leaf * PLACES + at[_groups(_near(points[at], points[at], eps))]
                yield pd.DataFrame({
                    "leaf": [block.leaf], "points": [block.points], "keys": [block.keys], "core": [core.tobytes()], "groups": [groups.tobytes()],
                    "cores": [len(at)], "others": [len(points) - len(at)], "members": [np.unique(groups[at]).tolist()],
                })

    lists = counts.groupBy("leaf").agg(F.collect_list(F.struct("i", "n")).alias("counts"))  # at most a block's points
    return blocks.join(lists, "leaf", "left").mapInPandas(label, LABELLED)


def _unsettled(pairs: DataFrame, labelled: DataFrame, merged: DataFrame) -> DataFrame:
    """The pairs of leaves that can still tell something: a border point next to core points, or groups of two components.

    ``merged`` has the component of every group (node) over the settled pairs."""
    spans = labelled.select("leaf", F.explode("members").alias("node")).join(merged, "node").groupBy("leaf").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    facts = labelled.select("leaf", "cores", "others").join(spans, "leaf", "left")
    border = "(a_cores > 0 AND b_others > 0) OR (b_cores > 0 AND a_others > 0)"
    apart = "a <> b AND a_cores > 0 AND b_cores > 0 AND least(a_least, b_least) < greatest(a_most, b_most)"
    return _paired(pairs, facts, ["cores", "others", "least", "most"]).filter(f"{border} OR ({apart})").select("a", "b")


def _met(pairs: DataFrame, labelled: DataFrame, width: int, eps: float) -> DataFrame:
    """(a, b, border): links between groups of different leaves, and border points with the groups they touch."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair in batch.itertuples():
                near = _near(_points(pair.a_points, width), _points(pair.b_points, width), eps)
                left, right = _longs(pair.a_groups), _longs(pair.b_groups)
                by_left, left_names = _by_group(near, left)
                by_right, right_names = _by_group(near.T, right)
                links, touches = np.empty((0, 2), dtype=np.int64), []
                if pair.a != pair.b:
                    i, j = np.nonzero(_by_group(by_left.T, right)[0])
                    links = np.stack([left_names[j], right_names[i]], axis=1)
                    i, j = np.nonzero(by_left & (right < 0))
                    touches.append(np.stack([pair.b * PLACES + j, left_names[i]], axis=1))
                i, j = np.nonzero(by_right & (left < 0))
                touches = np.concatenate([*touches, np.stack([pair.a * PLACES + j, right_names[i]], axis=1)])
                rows = np.concatenate([links, touches])
                if len(rows):
                    yield pd.DataFrame({"a": rows[:, 0], "b": rows[:, 1], "border": np.arange(len(rows)) >= len(links)})

    wanted = _paired(_dealt(pairs), labelled, ["points", "groups"])
    return wanted.mapInPandas(meet, "a long, b long, border boolean")


# --- merging ------------------------------------------------------------------------


def components(nodes: DataFrame, links: DataFrame, node: str = "node") -> DataFrame:
    """(node, component): the smallest node number reachable over ``links`` (a, b).

    Every node takes the smallest label around it and then jumps to the label of its label, so long chains take few
    rounds; each round is cut off by a written table."""
    work_dir(nodes.sparkSession)
    both = _written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = _written(nodes.select(F.col(node).alias("node"), F.col(node).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("around"))
        spread = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select(
            "node", F.col("component").alias("old"), F.least("component", F.coalesce("around", "component")).alias("component")
        )
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("beyond"))
        moved = _written(spread.join(jump, F.col("component") == F.col("at"), "left").select(
            "node", "old", F.least("component", F.coalesce("beyond", "component")).alias("component")
        ))
        labels = moved.select("node", "component")
        if moved.filter("component <> old").isEmpty():
            return labels


def _settled_links(sure: DataFrame, groups: DataFrame) -> DataFrame:
    """Links of settled pairs: where both nodes have core points, all their groups are one.

    ``groups`` has (level, node, group) for every group below every node."""
    first = groups.groupBy("level", "node").agg(F.min("group").alias("first"))
    sides = [first.select("level", F.col("node").alias(s), F.col("first").alias(f"{s}_first")) for s in ("a", "b")]
    joined = sure.join(sides[0], ["level", "a"]).join(sides[1], ["level", "b"])
    inside = _both_ways(joined, "first").select("level", "node").distinct().join(groups, ["level", "node"]).join(first, ["level", "node"])
    across = joined.select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    return across.unionByName(inside.select(F.col("first").alias("a"), F.col("group").alias("b"))).filter("a <> b").distinct()


def dbscan(df: DataFrame, features: Sequence[str], key: str, eps: float = 0.8, min_samples: int = 5, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Rows with ``cluster`` (-1 is noise) and ``core``; exact for any number of features.

    Equal rows are one point with a weight.  Clusters are numbered by the smallest ``key`` of their core rows, border rows
    join the lowest-numbered cluster within ``eps``.  Rows with a missing or non-finite feature are noise.
    """
    spark, features = df.sparkSession, list(features)
    if not 0 < leaf_rows <= PLACES:
        raise ValueError(f"a leaf holds 1 to {PLACES} points")
    work_dir(spark)
    width = len(features)
    numbers = [F.col(f).cast("double") for f in features]
    complete = reduce(lambda x, y: x & y, [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf) for c in numbers])
    # adding zero makes the two zeros one
    spots = df.filter(complete).groupBy(*[(c + 0.0).alias(f) for c, f in zip(numbers, features, strict=True)])
    spots = spots.agg(F.count("*").alias("rows"), F.min(key).cast("long").alias("key")).select(F.array(*features).alias("point"), "rows", F.coalesce("key", F.lit(0).cast("long")).alias("key"))
    placed, depth = _laid_out(spots, leaf_rows)
    nodes = _nodes(placed, width, depth)
    sure, pairs = _node_pairs(nodes, depth, eps)
    sure, pairs = _written(sure), _written(pairs)

    leaves = nodes.filter(F.col("level") == depth).select(F.col("node").alias("leaf"))
    above = _written(_ancestors(leaves, depth))
    given = _both_ways(sure, "rows").groupBy("level", "node").agg(F.sum("rows").alias("given"))
    given = above.join(given, ["level", "node"]).groupBy("leaf").agg(F.sum("given").alias("given"))
    weighed = placed.join(given, "leaf", "left").withColumn("given", F.coalesce("given", F.lit(0)).cast("long"))
    blocks = _written(weighed.groupBy("leaf").applyInPandas(_pack, BLOCK))
    with _few_rows(spark):
        counts = _written(_counted(pairs, blocks, width, eps, min_samples))
        labelled = _written(_labelled(blocks, counts, width, eps, min_samples))

    members = labelled.select("leaf", F.explode("members").alias("group"))
    below = _written(above.join(members, "leaf").select("level", "node", "group"))
    settled = components(members, _settled_links(sure, below), "group")
    open_pairs = _written(_unsettled(pairs, labelled, settled))
    with _few_rows(spark):
        met = _written(_met(open_pairs, labelled, width, eps))
    # links between groups become links between what the settled pairs already joined
    sides = [settled.select(F.col("node").alias(s), F.col("component").alias(f"{s}_in")) for s in ("a", "b")]
    links = met.filter("NOT border").select("a", "b").join(sides[0], "a").join(sides[1], "b").select(F.col("a_in").alias("a"), F.col("b_in").alias("b"))
    joined = components(settled.select("component").distinct(), links, "component").select(F.col("node").alias("component"), F.col("component").alias("whole"))
    merged = _written(settled.join(joined, "component").select("node", F.col("whole").alias("component")))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in batch.itertuples():
                points, groups = _points(block.points, width), _longs(block.groups)
                yield pd.DataFrame({"leaf": block.leaf, "id": block.leaf * PLACES + np.arange(len(points)), "point": list(points), "key": _longs(block.keys), "group": groups})

    with _few_rows(spark):
        every = _written(labelled.select("leaf", "points", "keys", "groups").mapInPandas(rows, "leaf long, id long, point array<double>, key long, group long"))
    merged = merged.select(F.col("node").alias("group"), "component")
    first = every.join(merged, "group").groupBy("component").agg(F.min("key").alias("key"))
    numbered, _ = with_ordinal(first, ["key", "component"], "cluster")
    named = _written(merged.join(numbered.select("component", "cluster"), "component").select("group", "cluster"))
    touched = met.filter("border").join(named, F.col("b") == F.col("group")).groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("touched"))
    lowest = below.join(named, "group").groupBy("level", "node").agg(F.min("cluster").alias("lowest"))
    sides = [lowest.select("level", F.col("node").alias(s), F.col("lowest").alias(f"{s}_lowest")) for s in ("a", "b")]
    reached = _both_ways(sure.join(sides[0], ["level", "a"], "left").join(sides[1], ["level", "b"], "left"), "lowest")
    reached = reached.groupBy("level", "node").agg(F.min("lowest").alias("reached"))
    reached = above.join(reached, ["level", "node"]).groupBy("leaf").agg(F.min("reached").alias("reached"))
    judged = every.join(named, "group", "left").join(touched, "id", "left").join(reached, "leaf", "left")
    core = F.col("group") >= 0
    label = F.when(core, F.col("cluster")).otherwise(F.least("touched", "reached"))
    labels = judged.select(*[F.get("point", F.lit(i)).alias(f"_at{i}") for i in range(width)], label.alias("cluster"), core.alias("core"))
    on = reduce(lambda x, y: x & y, [F.col(f"r.{f}").cast("double") == F.col(f"l._at{i}") for i, f in enumerate(features)])
    found = df.alias("r").join(labels.alias("l"), on, "left")
    return found.select("r.*", F.coalesce("l.cluster", F.lit(-1).cast("long")).alias("cluster"), F.coalesce("l.core", F.lit(False)).alias("core"))
