"""Hard negatives by exact scores: integer inner products from float32 matrix products modulo small primes, then windows.

Components become integers, a score is the inner product of two rows.  Every product of a block of anchors with a tile of
rows is taken modulo several primes: residues are centred and so small that float32 sums of a panel of columns are exact.
Chinese remaindering (mixed radix with centred digits) gives back the signed score.  Two passes use it: the first finds
the positives of each anchor, the second the rows of other labels whose score lies in the window of each positive.

Defined handling: rows with a null label or vector, or a null or non-finite component, take no part; neither do rows whose
squared length reaches 2^50 as integers, since their scores leave the range of the selection.  Shorter vectors count as
filled up with zeros.  A row without an id can be a positive or a negative and comes after all ids among equal scores.
Rows that repeat an id or a whole row are rows of their own.  An empty table, or one without anchors, gives no rows.
Columns besides the named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import arrow_rows, col, materialise, session_of, sorted_groups

#: Columns whose products one float32 sum takes; all sums stay below 2^24 in size, so each step is exact.
PANEL = 64
EXACT = 1 << 24
#: Squared lengths stay below this, so scores times 100 fit a long.
LARGEST = float(1 << 50)
#: Rows of a tile, anchors of a block (about: anchors are dealt by hash), anchors of one matrix product.
TILE, BLOCK, STEP = 1024, 2048, 512

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def moduli(reach: int, columns: int) -> list[int]:
    """The largest primes whose centred residues keep a panel's sums exact, so many that signed scores up to ``reach`` are told apart."""
    panel = max(1, min(columns, PANEL))
    found: list[int] = []
    product, candidate = 1, int(2 * (EXACT / panel) ** 0.5)
    candidate = min(candidate, 4093)
    while product <= 4 * (reach + 1):
        while ((candidate - 1) // 2 + 1) ** 2 * panel >= EXACT or any(candidate % d == 0 for d in range(2, int(candidate**0.5) + 1)):
            candidate -= 1
        found.append(candidate)
        product *= candidate
        candidate -= 1
    return found


def _centred(values: np.ndarray, prime: int) -> np.ndarray:
    return values - prime * np.rint(values / prime)


def residues(matrix: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Centred remainders of an integer matrix as float32, one matrix for each prime."""
    made = []
    for prime in primes:
        rest = np.mod(matrix, prime)
        made.append((rest - prime * (rest > prime // 2)).astype(np.float32))
    return made


def exact_scores(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """All inner products of the rows of two matrices given by their residues, as exact signed longs."""
    digits: list[np.ndarray] = []
    for k, prime in enumerate(primes):
        width = left[k].shape[1]
        rest = np.zeros((left[k].shape[0], right[k].shape[0]))
        for begin in range(0, width, PANEL):
            part = left[k][:, begin : begin + PANEL] @ right[k][:, begin : begin + PANEL].T
            rest = _centred(rest + part, prime)
        for digit, other in zip(digits, primes, strict=False):
            rest = _centred((rest - digit) * pow(other, -1, prime), prime)
        digits.append(rest)
    score = np.zeros(digits[-1].shape, dtype=np.int64) if digits else np.zeros((left[0].shape[0], right[0].shape[0]), dtype=np.int64)
    for digit, prime in zip(reversed(digits), reversed(primes), strict=True):
        score = score * prime + digit.astype(np.int64)
    return score


def quantised(df: DataFrame, id_col: str, vector: str, label: Column, anchor: Column, scale: float) -> DataFrame:
    """The rows that take part: id, label, is_anchor, and floor(scale * component) as an array of longs."""
    value = col(vector)
    fits = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float(1 << 25)))
    rows = df.select(
        F.coalesce(col(id_col).cast("long"), F.lit(0)).alias("id"), col(id_col).isNull().alias("no_id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
        F.when(F.coalesce(fits, F.lit(False)), F.transform(value, lambda x: F.floor(x.cast("double") * scale).cast("long"))).alias("q"),
    )
    size = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.where(F.col("label").isNotNull() & F.col("q").isNotNull()).withColumn("size", size).where(F.col("size") < LARGEST)


def _tiles(rows: DataFrame, width: int, kind: str, slices: int) -> DataFrame:
    """Up to TILE rows of a partition as one row of binary columns; a row's key is its tile and its place there."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            for begin in range(0, len(batch), TILE):
                some = batch.iloc[begin : begin + TILE]
                matrix = np.zeros((len(some), width), dtype=kind)
                for i, vector in enumerate(some["q"]):
                    matrix[i, : len(vector)] = vector
                tile = (part << 31) + count
                count += 1
                yield pd.DataFrame({
                    "tile": [tile], "slice": [(part * 31 + count) % slices], "ids": [some["id"].to_numpy(np.int64).tobytes()],
                    "no_id": [some["no_id"].to_numpy(bool).tobytes()], "labels": [some["label"].to_numpy(np.int64).tobytes()],
                    "anchors": [some["is_anchor"].to_numpy(bool).tobytes()], "vectors": [matrix.tobytes()],
                })

    schema = "tile long, slice int, ids binary, no_id binary, labels binary, anchors binary, vectors binary"
    return rows.select("id", "no_id", "label", "is_anchor", "q").mapInPandas(pack, schema)


def _unpack(row, width: int, kind: str) -> dict[str, np.ndarray]:
    ids = np.frombuffer(row.ids, dtype=np.int64)
    return {
        "id": ids, "no_id": np.frombuffer(row.no_id, dtype=bool), "label": np.frombuffer(row.labels, dtype=np.int64),
        "vector": np.frombuffer(row.vectors, dtype=kind).reshape(len(ids), width).astype(np.int64),
    }


def _blocks(tiles: DataFrame, width: int, kind: str, blocks: int) -> DataFrame:
    """The anchors of all tiles, dealt by the hash of their key to blocks of about BLOCK."""
    step = width * np.dtype(kind).itemsize

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                at = np.flatnonzero(np.frombuffer(row.anchors, dtype=bool))
                ids, no_id = np.frombuffer(row.ids, dtype=np.int64)[at], np.frombuffer(row.no_id, dtype=bool)[at]
                yield pd.DataFrame({
                    "key": (row.tile << 10) + at, "id": ids, "no_id": no_id, "label": np.frombuffer(row.labels, dtype=np.int64)[at],
                    "vector": [row.vectors[i * step : (i + 1) * step] for i in at],
                })

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in sorted_groups(batches, ["block"], 1):
            for block, rows in some.groupby("block"):
                yield pd.DataFrame({
                    "block": [block], "keys": [rows["key"].to_numpy(np.int64).tobytes()], "ids": [rows["id"].to_numpy(np.int64).tobytes()],
                    "no_id": [rows["no_id"].to_numpy(bool).tobytes()], "labels": [rows["label"].to_numpy(np.int64).tobytes()],
                    "vectors": [b"".join(rows["vector"])],
                })

    anchors = tiles.mapInPandas(pick, "key long, id long, no_id boolean, label long, vector binary")
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    dealt = dealt.repartition("block").sortWithinPartitions("block", "key")
    return dealt.mapInPandas(pack, "block int, keys binary, ids binary, no_id binary, labels binary, vectors binary")


class Best:
    """The first ``k`` rows of each group by falling score, ids without null, then key; fed tile by tile."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.least = np.full(groups, np.iinfo(np.int64).min)
        self.held = [np.empty(0, dtype=np.int64) for _ in range(5)]  # group, score, no id, id, key

    def add(self, group: np.ndarray, score: np.ndarray, no_id: np.ndarray, ids: np.ndarray, key: np.ndarray) -> None:
        near = score >= self.least[group]
        if not near.any():
            return
        new = [x[near].astype(np.int64) for x in (group, score, no_id, ids, key)]
        group, score, no_id, ids, key = (np.concatenate(x) for x in zip(self.held, new, strict=True))
        order = np.lexsort((key, ids, no_id, -score, group))
        sorted_group = group[order]
        begin = np.flatnonzero(np.concatenate(([True], sorted_group[1:] != sorted_group[:-1])))
        place = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
        order, place = order[place < self.k], place[place < self.k]
        self.held = [x[order] for x in (group, score, no_id, ids, key)]
        full = place == self.k - 1
        self.least[self.held[0][full]] = self.held[1][full]


def _search(pairs: DataFrame, width: int, kind: str, primes: list[int], slots: int, k: int, choose) -> DataFrame:
    """For each anchor and slot the best ``k`` rows of each task.

    ``choose(score, block, tile, at)`` yields (slot, mask of rows to take) for the anchors ``at`` of a block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, best, number = None, None, None

        def flush() -> Iterator[pd.DataFrame]:
            if best is None or not len(best.held[0]):
                return
            group, score, no_id, ids, key = best.held
            at = group // slots
            yield pd.DataFrame({
                "anchor": block["key"][at], "anchor_id": pd.arrays.IntegerArray(block["id"][at], block["no_id"][at]),
                "slot": (group % slots).astype(np.int32), "score": score, "id": pd.arrays.IntegerArray(ids, no_id.astype(bool)), "key": key,
            })

        for batch in batches:
            for row in batch.itertuples():
                if row.block != number:
                    yield from flush()
                    number, block = row.block, _unpack_block(row, width, kind)
                    block["parts"] = [residues(block["vector"][b : b + STEP], primes) for b in range(0, len(block["id"]), STEP)]
                    best = Best(len(block["id"]) * slots, k)
                tile = _unpack(_Renamed(row), width, kind)
                tile["key"] = (row.tile << 10) + np.arange(len(tile["id"]))
                right = residues(tile["vector"], primes)
                for part, begin in zip(block["parts"], range(0, len(block["id"]), STEP), strict=True):
                    at = np.arange(begin, begin + part[0].shape[0])
                    score = exact_scores(part, right, primes)
                    for slot, mask in choose(score, block, tile, at):
                        mask &= score >= best.least[at * slots + slot][:, None]
                        _nearest(mask, score, k)
                        i, j = np.nonzero(mask)
                        best.add(at[i] * slots + slot, score[i, j], tile["no_id"][j], tile["id"][j], tile["key"][j])
        yield from flush()

    return pairs.mapInPandas(run, "anchor long, anchor_id long, slot int, score long, id long, key long")


def _nearest(mask: np.ndarray, score: np.ndarray, k: int) -> None:
    """Leave in each row of ``mask`` the places with one of the k largest scores, equal ones included."""
    if mask.shape[1] <= k:
        return
    held = np.where(mask, score, np.iinfo(np.int64).min)
    least = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
    mask &= held >= least[:, None]


class _Renamed:
    """The tile's columns of a joined row."""

    def __init__(self, row):
        self.ids, self.no_id, self.labels, self.vectors = row.t_ids, row.t_no_id, row.t_labels, row.t_vectors


def _unpack_block(row, width: int, kind: str) -> dict[str, np.ndarray]:
    block = _unpack(row, width, kind)
    block["key"] = np.frombuffer(row.keys, dtype=np.int64)
    if hasattr(row, "windows"):
        order = np.argsort(block["key"])
        places = {n: np.array([w[n] for w in row.windows], dtype=np.int64) for n in ("anchor", "slot", "score")}
        at = order[np.searchsorted(block["key"], places["anchor"], sorter=order)]
        slots = int(places["slot"].max()) + 1
        block["positive"] = np.zeros((len(order), slots), dtype=np.int64)
        block["has"] = np.zeros((len(order), slots), dtype=bool)
        block["positive"][at, places["slot"]] = places["score"]
        block["has"][at, places["slot"]] = True
    return block


def mine(
    df: DataFrame, id_col: str, vector: str, label: Column, anchor: Column, scale: float = 256.0, positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, whole: int = 100,
) -> DataFrame:
    """The first ``negatives`` rows of other labels for each anchor and each of its first ``positives`` rows of its own label.

    A row is a hard negative of a positive if ``low * positive_score <= whole * negative_score <= high * positive_score``.
    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Every block of anchors meets every tile of rows: tiles are copied once for each block, blocks once for each slice of the
    tiles.  A task holds one block, one tile and the best rows so far; what leaves it are at most ``positives * negatives``
    rows an anchor.
    """
    spark = session_of(df)
    rows = quantised(df, id_col, vector, label, anchor, scale)
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("anchors"), F.max(F.size("q")).alias("width"), F.max("size").alias("size"),
        F.max(F.array_max(F.transform("q", F.abs))).alias("largest"),
    ).first()
    if not facts["anchors"]:
        return spark.createDataFrame([], RESULT)
    width, largest = max(1, facts["width"]), facts["largest"] or 0
    kind = "int16" if largest < 1 << 15 else "int32"
    primes = moduli(int(facts["size"]), width)
    blocks = -(-facts["anchors"] // BLOCK)
    tasks = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    slices = max(1, min(-(-facts["n"] // TILE), -(-tasks // blocks)))

    with arrow_rows(spark, TILE):
        tiles = materialise(_tiles(rows, width, kind, slices), "tiles")
    with arrow_rows(spark, 8):
        anchors = materialise(_blocks(tiles, width, kind, blocks), "anchors")
    renamed = tiles.select("tile", "slice", *[F.col(c).alias(f"t_{c}") for c in ("ids", "no_id", "labels", "vectors")])
    copies = renamed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition("block", "slice")

    def paired(side: DataFrame) -> DataFrame:
        return copies.join(side.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))), ["block", "slice"])

    def same_label(score, block, tile, at):
        yield 0, (block["label"][at][:, None] == tile["label"]) & (block["key"][at][:, None] != tile["key"])

    def in_window(score, block, tile, at):
        other = block["label"][at][:, None] != tile["label"]
        hundredfold = score * whole
        for slot in range(block["has"].shape[1]):
            wanted = block["positive"][at, slot][:, None]
            yield slot, other & block["has"][at, slot][:, None] & (low * wanted <= hundredfold) & (hundredfold <= high * wanted)

    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("key")]
    with arrow_rows(spark, 8):
        near = _search(paired(anchors), width, kind, primes, 1, positives, same_label)
        place = F.row_number().over(Window.partitionBy("anchor").orderBy(*order))
        # the task's own best go through the window only; at most `positives` rows of an anchor are left
        chosen = near.withColumn("place", place).where(F.col("place") <= positives).withColumn("slot", F.col("place") - 1)
        chosen = materialise(chosen.select("anchor", "anchor_id", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        windows = chosen.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int").alias("block")).agg(
            F.collect_list(F.struct("anchor", "slot", F.col("positive_score").alias("score"))).alias("windows")
        )
        far = _search(paired(anchors.join(windows, "block")), width, kind, primes, positives, negatives, in_window)
        place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(*order))
        found = far.withColumn("rank", place).where(F.col("rank") <= negatives)
        made = found.select("anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        made = materialise(made.join(chosen, ["anchor", "slot"]), "negatives")
    return made.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

