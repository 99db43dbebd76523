"""Near-duplicates by SimHash fingerprints and BK-trees.

A fingerprint has a bit for each majority among the hashes of a text's word shingles.  Distinct fingerprints are dealt into
shards that agree on a block of bits (with one block more than the distance allowed, two near fingerprints agree on at
least one).  Each shard holds a BK-tree: a child hangs on the integer distance to its parent, and a search for distance r
follows only the edges within r of the distance to the node.  Shards that are too large are dealt again by their other bits.
The trees grow with the data, so each stays in the task of its shard instead of being broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import col, components, materialise, sorted_groups, words_of

BITS = 64


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """Majority bits over the XXH64 (seed 42) of all shingles, repeats included; 0 for a text without words."""
    words = words_of(text)
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(shingle, len(words)) - 1
    spans = zip(starts[: len(words) - span].tolist(), ends[span:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    n = len(words) - span
    hashes = np.fromiter((digest(flat[a:b], 42) for a, b in spans), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for long texts
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(df: DataFrame, text: str = "text", shingle: int = 3, name: str = "fingerprint") -> DataFrame:
    """All rows with a signed 64-bit fingerprint.  Null or blank text: 0."""

    @F.pandas_udf("long")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, shingle) for t in texts], np.uint64).view(np.int64))

    return df.withColumn(name, made(col(text).cast("string")))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each count n, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def bk_forest(keys: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of all distinct ``tree`` numbers (sorted) at once: parent and edge of each key, and the root of each tree.

    Level by level: the first key of a bucket becomes a node, the others go to its child buckets by their distance to it.
    """
    n = len(keys)
    parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int16)
    rows = np.arange(n)
    bucket_parent, bucket_edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    bucket = tree.astype(np.int64)
    while len(rows):
        first = np.concatenate(([True], bucket[1:] != bucket[:-1]))
        node = rows[first][np.cumsum(first) - 1]
        parent[rows[first]] = bucket_parent[first]
        edge[rows[first]] = bucket_edge[first]
        rows, node = rows[~first], node[~first]
        far = _distance(keys[rows], keys[node]).astype(np.int64)
        group = node * (BITS + 1) + far
        order = np.argsort(group, kind="stable")
        rows, bucket, bucket_parent, bucket_edge = rows[order], group[order], node[order], far[order]
    roots = np.flatnonzero(parent < 0)
    return parent, edge, roots


def bk_links(keys: np.ndarray, tree: np.ndarray, radius: int, block: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j in the same tree, with at most ``radius`` differing bits; found by walking the trees.

    Queries go in blocks, so that the frontier stays bounded.
    """
    parent, edge, roots = bk_forest(keys, tree)
    order = np.lexsort((edge, parent))
    order = order[parent[order] >= 0]
    child_parent, child_edge = parent[order], edge[order].astype(np.int64)
    width = BITS + 2
    child_key = child_parent * width + child_edge
    root_of = roots[np.searchsorted(tree[roots], tree)]
    waiting = [(np.arange(at, min(at + block, len(keys))), None) for at in range(0, len(keys), block)][::-1]
    while waiting:
        query, node = waiting.pop()
        node = root_of[query] if node is None else node
        far = _distance(keys[query], keys[node]).astype(np.int64)
        near = (far <= radius) & (query < node)
        if near.any():
            yield query[near], node[near]
        low = np.searchsorted(child_key, node * width + np.maximum(far - radius, 0))
        high = np.searchsorted(child_key, node * width + np.minimum(far + radius, BITS), side="right")
        counts = high - low
        if not counts.any():
            continue
        query, node = np.repeat(query, counts), order[np.repeat(low, counts) + _ranges(counts)]
        for at in range(0, len(query), 4 * block):
            waiting.append((query[at : at + 4 * block], node[at : at + 4 * block]))


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give a and b, and all that share their labels, the smallest label."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def shard_links(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """For each shard the links from every fingerprint that has a partner to the first of its group."""
    for block in sorted_groups(batches, ["shard"]):
        keys, shard = block["fp"].to_numpy(np.int64), block["shard"].to_numpy(np.int64)
        order = np.lexsort((keys, shard))
        keys, shard = keys[order], shard[order]
        begin = np.concatenate(([True], shard[1:] != shard[:-1]))
        number = np.cumsum(begin) - 1
        keep = np.bincount(number)[number] > 1
        keys, number = keys[keep], number[keep]
        if not len(keys):
            continue
        label = np.arange(len(keys))
        bits = keys.view(np.uint64)
        for a, b in bk_links(bits, number, radius):
            _merged(label, a, b)
        linked = label != np.arange(len(keys))
        yield pd.DataFrame({"u": keys[linked], "v": keys[label[linked]]})


def _pieces(low: int, high: int, parts: int) -> list[tuple[int, int]]:
    """Split the bits low..high-1 into ``parts`` runs."""
    cuts = [low + (high - low) * i // parts for i in range(parts + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _block_value(at: int, to: int):
    return F.shiftrightunsigned(F.col("fp"), at).bitwiseAND(F.lit((1 << (to - at)) - 1))


def fingerprint_links(prints: DataFrame, radius: int = 3, shard_rows: int = 4096, rounds: int = 3) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints ``fp`` within ``radius`` bits, transitively.

    Round 1 deals by one of radius+1 blocks.  A shard of more than ``shard_rows`` fingerprints is dealt again by
    radius+1 blocks of the bits in which its members may still differ, up to ``rounds`` times; what is still larger then is
    close together in nearly all bits and stays whole, so nothing is lost.
    """
    parts = radius + 1
    if parts > BITS:
        raise ValueError("the radius must be below 64")
    blocks = [[(a, b)] for a, b in _pieces(0, BITS, parts)]
    level = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("way"), _block_value(*w[0]).alias("value")) for i, w in enumerate(blocks)])).alias("s")).select("fp", F.xxhash64("s.way", "s.value").alias("shard"), F.col("s.way").alias("way"))
    ready: list[DataFrame] = []
    free = [[(lo, hi) for lo, hi in [(0, w[0][0]), (w[0][1], BITS)] if hi > lo] for w in blocks]
    for step in range(rounds):
        level = materialise(level, "shards")
        large = level.groupBy("shard").count().where(F.col("count") > shard_rows).select("shard")
        if step == rounds - 1 or not large.limit(1).count():
            ready.append(level)
            break
        ready.append(level.join(large, "shard", "left_anti"))
        crowded = level.join(large, "shard")
        pieces, new_free, taken = [], [], 0
        for way, runs in enumerate(free):
            bits = [b for lo, hi in runs for b in range(lo, hi)]
            for part in range(parts):
                own = bits[len(bits) * part // parts : len(bits) * (part + 1) // parts]
                value = F.lit(0).cast("long")
                for lo, hi in _runs(own):
                    value = F.xxhash64(value, _block_value(lo, hi))
                pieces.append((way, taken, value))
                new_free.append(_runs([b for b in bits if b not in own]))
                taken += 1
        deals = F.array(*[F.when(F.col("way") == way, F.struct(F.lit(n).alias("way"), value.alias("value"))) for way, n, value in pieces])
        level = (
            crowded.select("fp", "shard", F.explode(F.filter(deals, lambda x: x.isNotNull())).alias("s"))
            .select("fp", F.xxhash64("shard", "s.way", "s.value").alias("shard"), F.col("s.way").alias("way"))
        )
        free = new_free
    links = None
    for rows in ready:
        dealt = rows.select("fp", "shard").repartition("shard").sortWithinPartitions("shard", "fp")
        found = dealt.mapInPandas(lambda batches: shard_links(batches, radius), "u long, v long")
        links = found if links is None else links.unionByName(found)
    return links


def _runs(bits: list[int]) -> list[tuple[int, int]]:
    """Consecutive bit numbers as (from, to) pairs."""
    found: list[tuple[int, int]] = []
    for b in bits:
        if found and found[-1][1] == b:
            found[-1] = (found[-1][0], b + 1)
        else:
            found.append((b, b + 1))
    return found


def near_components(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over
    links of at most ``radius`` differing bits, itself included.

    Equal fingerprints are one node, so a group of copies of any size costs one row.  Null, empty and blank texts have
    fingerprint zero and link like any other.  Repeated rows are all returned; null ids are never the smallest unless a
    component has no other.  An empty table gives an empty result.
    """
    own = with_fingerprints(df.select(col(doc_id).alias("doc_id"), col(text).alias("__text")), "__text", shingle, "fp")
    prints = materialise(own.select("doc_id", "fp"), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(fingerprint_links(nodes.select("fp"), radius))
    placed = nodes.join(roots, nodes["fp"] == roots["u"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    owner = placed.join(least, "root").select("fp", "component_id")
    return prints.join(owner, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one_per_group(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows whose id is their component's smallest: all columns, one document of each group.

    Rows that repeat an id are kept once.  Rows with a null id belong to no other row's group and are kept.
    """
    found = near_components(df, doc_id, text, shingle, radius)
    keep = found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg((F.count(F.lit(1)) > 1).alias("__again"))
    kept = df.join(keep.withColumnRenamed("doc_id", "__keep"), col(doc_id) == F.col("__keep"))
    once = kept.where("not __again").select(*map(col, df.columns))
    again = kept.where("__again").select(*map(col, df.columns)).dropDuplicates([doc_id])
    return once.unionByName(again).unionByName(df.where(col(doc_id).isNull()))
