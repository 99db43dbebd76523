"""Helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import itertools
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import scratch_path, work_dir

UNIT = 0x9E3779B97F4A7C15


def col(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


#: Paths written in each open ``scratch`` block, the innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write once to the shared folder and read back: lost executors then never recompute what stands before.

    In a ``scratch`` block the table lives as long as the block, with ``keep`` as long as the block around it."""
    path = scratch_path(session_of(df), name)
    blocks = _OPEN.get()[:-1] if keep else _OPEN.get()
    if blocks:
        blocks[-1].append(path)
    df.write.parquet(path)
    return session_of(df).read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` writes inside are deleted at the end: what is needed later must be written with ``keep``."""
    own: list[str] = []
    token = _OPEN.set((*_OPEN.get(), own))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for name in own:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    work_dir(session_of(df))
    return df.checkpoint()


def fold_of(name: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(col(name).cast("string"), F.lit("")).cast("binary")) % parts


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words between the six ASCII white-space characters, as UTF-8 bytes."""
    return text.encode().lower().split() if text else []


def sorted_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = 200_000) -> Iterator[pd.DataFrame]:
    """Blocks that hold whole groups, from batches that are sorted by ``keys``.

    A block holds at least ``rows`` rows (but for the last), never part of a group.
    """
    held: list[pd.DataFrame] = []
    size = 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch)
            if size < rows:
                continue
        if not held:
            return
        block = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        if batch is None:
            yield block
            return
        last = block[keys].iloc[-1]
        same = np.ones(len(block), dtype=bool)
        for key in keys:
            same &= block[key].to_numpy() == last[key]
        end = len(block) - int(same.sum())
        if end:
            yield block.iloc[:end].reset_index(drop=True)
        held = [block.iloc[end:].reset_index(drop=True)]
        size = len(held[0])


def arrays_by(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """One row for each ``key`` (long) with an array of longs for each of ``values``, sorted by ``order``.

    Rows are sorted and streamed instead of aggregated, so a task holds a block of rows and no table of groups."""
    names = list(dict.fromkeys([*order, *values]))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in sorted_groups(batches, [key], 50_000):
            keys = block[key].to_numpy(np.int64)
            begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            out = {key: keys[begin]}
            for value in values:
                out[value] = pd.Series(np.split(block[value].to_numpy(np.int64), begin[1:]), dtype=object)
            yield pd.DataFrame(out)

    rows = df.select(key, *names).repartition(key).sortWithinPartitions(key, *order)
    return rows.mapInPandas(gather, f"{key} long, " + ", ".join(f"{v} array<long>" for v in values))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Fewer rows in the batches that go to Python, for the jobs that run inside: texts make large rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """Connected components of ``edges`` (u, v): rows (u, root), root the smallest member; nodes without an edge are absent.

    Alternating large-star and small-star steps: every step only joins a node's edges with its smallest neighbour, so
    neither pairs within a component nor a component itself are ever gathered.  Each round is checkpointed.
    """

    def stars(pairs: DataFrame) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = state(now)
    for _ in range(rounds):
        now = cut(stars(now))
        after = state(now)
        if after == before:
            roots = now.select(F.col("v").alias("u")).distinct()
            return now.select("u", F.col("v").alias("root")).unionByName(roots.select("u", F.col("u").alias("root")))
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
