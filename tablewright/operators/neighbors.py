"""Exact nearest neighbours without pairing everything with everything.

Distinct points are laid out in boxes by a small split tree; a query is answered in its
own box first and then only in boxes that can hold something closer.  The tree comes
from a bounded sample and decides the layout, never the result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SAMPLE_ROWS = 20_000
LEAF_ROWS = 10_000
MAX_LEAVES = 4_096
BLOCK = 256


class SplitTree:
    """Median splits of a sample along the widest axis; ``leaf`` maps rows to box numbers."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.axis, self.cut, self.child = [], [], []
        self.leaves = 0
        self._grow(sample, max(1, leaves))

    def _grow(self, rows: np.ndarray, leaves: int) -> int:
        here = len(self.axis)
        spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(1)
        axis = int(np.argmax(spread))
        self.axis.append(axis)
        self.cut.append(0.0)
        self.child.append((-1, -1))
        if leaves <= 1 or not len(rows) or spread[axis] == 0:
            self.axis[here] = -1
            self.cut[here] = float(self.leaves)
            self.leaves += 1
            return here
        cut = float(np.median(rows[:, axis]))
        left = rows[:, axis] <= cut
        if left.all():
            cut = float(rows[:, axis][rows[:, axis] < cut].max())
            left = rows[:, axis] <= cut
        self.cut[here] = cut
        self.child[here] = (self._grow(rows[left], leaves // 2), self._grow(rows[~left], leaves - leaves // 2))
        return here

    def leaf(self, rows: np.ndarray) -> np.ndarray:
        axis, cut, child = np.array(self.axis), np.array(self.cut), np.array(self.child)
        at = np.zeros(len(rows), dtype=int)
        while True:
            inner = axis[at] >= 0
            if not inner.any():
                return cut[at].astype(int)
            node = at[inner]
            right = rows[inner, axis[node]] > cut[node]
            at[inner] = child[node, right.astype(int)]


def _matrix(frame: pd.DataFrame, features: Sequence[str]) -> np.ndarray:
    return frame[list(features)].to_numpy(dtype=float)


def _search(queries: np.ndarray, points: np.ndarray, first_key: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query the k nearest points by (distance, key)."""
    for start in range(0, len(queries), BLOCK):
        block = queries[start : start + BLOCK]
        squared = np.zeros((len(block), len(points)))
        for d in range(points.shape[1]):
            squared += (block[:, d, None] - points[None, :, d]) ** 2
        for i, row in enumerate(np.sqrt(squared)):
            if len(points) > k:
                edge = np.partition(row, k - 1)[k - 1]
                near = np.flatnonzero(row <= edge)
            else:
                near = np.arange(len(points))
            order = near[np.lexsort((first_key[near], row[near]))][:k]
            yield start + i, order, row[order]


@dataclass
class Layout:
    """Points in boxes, ready to be asked for at most ``k`` neighbours.

    ``placed`` has one row per distinct point with its box and the first ``k`` of the rows that stand there.  A stored layout
    is partitioned by box, and only the boxes that questions reach are read.
    """

    names: list[str]
    k: int
    tree: SplitTree
    placed: DataFrame
    load_type: T.DataType
    bounds: pd.DataFrame | None = None

    @property
    def stored(self) -> bool:
        return self.bounds is not None

    def box_of(self):
        tree = self.tree

        @F.pandas_udf("long")
        def box(*cols: pd.Series) -> pd.Series:
            return pd.Series(tree.leaf(np.column_stack([c.to_numpy(dtype=float) for c in cols])))

        return box(*self.names)

    def edges(self) -> pd.DataFrame:
        """The boxes as they really are: one row per leaf, at most MAX_LEAVES."""
        if self.stored:
            return self.bounds
        ends = [*[F.min(f).alias(f"lo_{f}") for f in self.names], *[F.max(f).alias(f"hi_{f}") for f in self.names]]
        return self.placed.groupBy("_leaf").agg(*ends).toPandas()

    def reached(self, questions: DataFrame) -> DataFrame:
        """The points that questions can need; their boxes become a filter on folders."""
        if not self.stored:
            return self.placed
        boxes = [r[0] for r in questions.select("_leaf").distinct().collect()]  # at most MAX_LEAVES
        return self.placed.filter(F.col("_leaf").isin(boxes) if boxes else F.lit(False))


def lay_out(points: DataFrame, features: Sequence[str], k: int, key: str, payload: str, leaf_rows: int = LEAF_ROWS) -> Layout:
    """Equal points are collapsed first, so a value that fills a third of the table costs one row."""
    names = list(features)
    kept = (
        points.select(*[F.col(f).cast("double").alias(f) for f in names], F.col(key).cast("long").alias("_key"), F.col(payload).alias("_load"))
        .dropna(subset=names)
        .withColumn("_rn", F.row_number().over(Window.partitionBy(*names).orderBy("_key")))
        .filter(F.col("_rn") <= k)
    )
    spots = kept.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("_key", "_load"))).alias("_held"))  # at most k each
    spots = spots.persist()
    total = spots.count()
    leaves = max(1, min(MAX_LEAVES, -(-total // leaf_rows)))
    sample = spots.select(*names).sample(min(1.0, 1.2 * SAMPLE_ROWS / total), seed=7).limit(SAMPLE_ROWS).toPandas() if leaves > 1 else pd.DataFrame(columns=names)  # bounded
    made = Layout(names, k, SplitTree(_matrix(sample, names), leaves), spots, points.schema[payload].dataType)
    made.placed = spots.withColumn("_leaf", made.box_of())
    return made


def store(layout: Layout, path: str) -> str:
    """Write a layout: points partitioned by box, the bounds of the boxes, and one row with the tree."""
    spark, tree = layout.placed.sparkSession, layout.tree
    layout.placed.repartition("_leaf").write.mode("overwrite").partitionBy("_leaf").parquet(f"{path}/boxes")
    schema = T.StructType([T.StructField("_leaf", T.LongType()), *[T.StructField(f"{end}_{f}", T.DoubleType()) for end in ("lo", "hi") for f in layout.names]])
    spark.createDataFrame(layout.edges()[schema.names], schema).write.mode("overwrite").parquet(f"{path}/bounds")
    facts = {
        "names": layout.names, "k": layout.k, "points": layout.placed.schema.json(),
        "tree": {"axis": tree.axis, "cut": tree.cut, "child": tree.child, "leaves": tree.leaves},
    }
    spark.createDataFrame([(json.dumps(facts),)], "facts string").write.mode("overwrite").parquet(f"{path}/tree")
    return path


def load(spark: SparkSession, path: str) -> Layout:
    facts = json.loads(spark.read.parquet(f"{path}/tree").first()["facts"])
    tree = SplitTree.__new__(SplitTree)
    tree.axis, tree.cut, tree.leaves = facts["tree"]["axis"], facts["tree"]["cut"], facts["tree"]["leaves"]
    tree.child = [tuple(c) for c in facts["tree"]["child"]]
    placed = spark.read.schema(T.StructType.fromJson(json.loads(facts["points"]))).parquet(f"{path}/boxes")
    load_type = placed.schema["_held"].dataType.elementType["_load"].dataType
    return Layout(facts["names"], facts["k"], tree, placed, load_type, spark.read.parquet(f"{path}/bounds").toPandas())


def nearest(
    queries: DataFrame,
    points: DataFrame,
    features: Sequence[str],
    k: int,
    key: str,
    payload: str,
    leaf_rows: int = LEAF_ROWS,
    slice_rows: int = LEAF_ROWS,
) -> DataFrame:
    """(features..., rank, distance, key, payload): the k nearest points of every distinct query row.

    Ties go to the smaller key.  Equal points and equal queries are collapsed first, so
    a value that fills a third of either table costs one row.
    """
    return ask_layout(lay_out(points, features, k, key, payload, leaf_rows), queries, k, slice_rows)


def ask_layout(layout: Layout, queries: DataFrame, k: int, slice_rows: int = LEAF_ROWS) -> DataFrame:
    """The k nearest points of every distinct query row, see ``nearest``."""
    if k > layout.k:
        raise ValueError(f"the layout holds {layout.k} rows of equal points, {k} are asked for")
    names, tree, load_type = layout.names, layout.tree, layout.load_type
    wanted = queries.select(*[F.col(f).cast("double").alias(f) for f in names]).dropna().distinct()
    asked = wanted.withColumn("_leaf", layout.box_of())
    fields = [*[T.StructField(f, T.DoubleType()) for f in names]]
    hit = T.StructType([*fields, T.StructField("distance", T.DoubleType()), T.StructField("key", T.LongType()), T.StructField("payload", load_type)])

    def answer(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {n: [] for n in hit.names}
        if len(q) and len(p):
            rows = _matrix(q, names)
            held = p["_held"].to_list()
            first = np.array([h[0]["_key"] for h in held])
            for i, order, distance in _search(rows, _matrix(p, names), first, k):
                best: list[tuple] = []
                for j, d in zip(order, distance, strict=True):
                    best.extend((float(d), int(e["_key"]), e["_load"]) for e in held[j])
                best.sort(key=lambda b: b[:2])
                for d, point, load in best[:k]:
                    for n, v in zip(names, rows[i], strict=True):
                        out[n].append(v)
                    out["distance"].append(d)
                    out["key"].append(point)
                    out["payload"].append(load)
        return pd.DataFrame(out, columns=hit.names)

    def ask(questions: DataFrame) -> DataFrame:
        """Answer (query, box) rows.  A box with many queries is answered in several slices."""
        sizes = questions.groupBy("_leaf").agg(F.ceil(F.count("*") / slice_rows).alias("_slices"))
        spread = F.pmod(F.xxhash64(*names), F.col("_slices"))
        sliced = questions.join(sizes, "_leaf").withColumn("_slice", spread).drop("_slices")
        copies = layout.reached(questions).join(sizes, "_leaf").withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1))).drop("_slices")
        return sliced.groupBy("_leaf", "_slice").cogroup(copies.groupBy("_leaf", "_slice")).applyInPandas(answer, hit)

    found = ask(asked)
    if tree.leaves > 1:
        edges = layout.edges()
        boxes = edges["_leaf"].to_numpy()
        low, high = edges[[f"lo_{f}" for f in names]].to_numpy(), edges[[f"hi_{f}" for f in names]].to_numpy()
        found = found.persist()
        reach = found.groupBy(*names).agg(F.when(F.count("*") >= k, F.max("distance")).alias("_reach"))
        open_rows = asked.join(reach, names, "left")
        more = T.StructType([*fields, T.StructField("_leaf", T.LongType())])

        def other_boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                rows = _matrix(frame, names)
                reach_now = frame["_reach"].fillna(np.inf).to_numpy()
                home = frame["_leaf"].to_numpy()
                for start in range(0, len(rows), BLOCK):
                    block = rows[start : start + BLOCK]
                    gap = np.maximum(np.maximum(low[None] - block[:, None], block[:, None] - high[None]), 0)
                    close = np.sqrt((gap**2).sum(axis=2)) <= reach_now[start : start + BLOCK, None] * (1 + 1e-12)
                    close &= boxes[None] != home[start : start + BLOCK, None]
                    who, where = np.nonzero(close)
                    out = pd.DataFrame(block[who], columns=names)
                    out["_leaf"] = boxes[where]
                    yield out

        found = found.unionByName(ask(open_rows.mapInPandas(other_boxes, more)))
    best = Window.partitionBy(*names).orderBy("distance", "key")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def knn_predict(
    queries: DataFrame,
    points: DataFrame | None = None,
    features: Sequence[str] = (),
    target: str | None = None,
    key: str | None = None,
    k: int = 5,
    weights: str = "uniform",
    task: str = "Regression",
    name: str = "prediction",
    index: Layout | None = None,
    **layout,
) -> DataFrame:
    """Mean or majority vote of the k nearest points; a missing feature gives NULL.

    Distance weights are 1/d, and exact matches decide alone when there are any.  A tied
    vote goes to the smaller label.  ``index`` is a layout of points with a target as payload;
    it takes the place of ``points``, ``target`` and ``key``.
    """
    found = ask_layout(index, queries, k) if index else nearest(queries, points.filter(F.col(target).isNotNull()), features, k, key, target, **layout)
    if weights == "distance":
        exact = F.min("distance").over(Window.partitionBy(*features)) == 0
        weight = F.when(exact, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
    else:
        weight = F.lit(1.0)
    voted = found.withColumn("_w", weight)
    if task == "Regression":
        made = voted.groupBy(*features).agg((F.sum(F.col("_w") * F.col("payload")) / F.sum("_w")).alias(name))
    else:
        votes = voted.groupBy(*features, "payload").agg(F.sum("_w").alias("_w"))
        made = votes.groupBy(*features).agg(F.min_by("payload", F.struct((-F.col("_w")).alias("w"), "payload")).alias(name))
    on = reduce(lambda a, b: a & b, [F.col(f"q.{f}").cast("double") == F.col(f"m.{f}") for f in features])
    return queries.alias("q").join(made.alias("m"), on, "left").select("q.*", F.col(f"m.{name}"))
