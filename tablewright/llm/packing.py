"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Only lengths decide a packing, so the plan is made from the histogram of piece lengths (one number per possible length,
whatever the size of the corpus).  It is a list of patterns: lengths that share a sequence, and how many sequences look so.
Each piece then finds its place by its rank among the pieces of its length; no piece is moved.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewright.llm.common import col, materialise


@dataclass(frozen=True)
class Pattern:
    lengths: tuple[int, ...]
    times: int


def plan_bins(histogram: dict[int, int], size: int) -> list[Pattern]:
    """Patterns that use up the histogram.

    A sequence is filled greedily, each time with the longest piece that fits.  Then its smallest piece is replaced by the
    two unused pieces that fit the gap, widened by that piece, best - as long as the gap gets smaller.  The pattern is used
    as often as the counts allow, which is what repeating the same choice would do.
    """
    left = np.zeros(size + 1, np.int64)
    for length, count in histogram.items():
        if not 0 < length <= size:
            raise ValueError(f"length {length} outside 1..{size}")
        left[length] = count
    longest = np.zeros(size + 1, np.int64)  # the longest unused length up to an index
    index = np.arange(size + 1)
    patterns = []
    while left.any():
        free = left.copy()

        def fits(free=free) -> np.ndarray:
            return np.maximum.accumulate(np.where(free > 0, index, 0), out=longest)

        chosen: list[int] = []
        gap = size
        while (length := int(fits()[gap])) > 0:
            times = min(gap // length, int(free[length]))
            chosen += [length] * times
            free[length] -= times
            gap -= length * times
        while gap:
            small = chosen[-1] if chosen[-1] == min(chosen) else min(chosen)
            room = gap + small
            first = np.flatnonzero(free[: room + 1] > 0)
            if not len(first):
                break
            top = fits()
            second = top[room - first]
            same = (second == first) & (free[first] < 2)
            if same.any():
                second = np.where(same, top[np.minimum(room - first, np.maximum(first - 1, 0))], second)
            total = np.where(second > 0, first + second, 0)
            best = int(total.argmax())
            if total[best] <= small:
                break
            chosen.remove(small)
            free[small] += 1
            for length in (int(first[best]), int(second[best])):
                chosen.append(length)
                free[length] -= 1
            gap = room - int(total[best])
        used = np.bincount(chosen, minlength=size + 1)
        times = int((left[used > 0] // used[used > 0]).min())
        left -= used * times
        patterns.append(Pattern(tuple(sorted(chosen, reverse=True)), times))
    return patterns


def _slots(patterns: list[Pattern], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each (length, rank): starts of the runs of ranks, with the first sequence and the offset of each run."""
    rows, sequence = [], 0
    for pattern in patterns:
        offset = 0
        for length in pattern.lengths:
            rows.append((length, pattern.times, sequence, offset))
            offset += length
        sequence += pattern.times
    rows.sort(key=lambda r: r[0])
    lengths, times, first, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.empty(0, np.int64)] * 4
    starts = np.cumsum(times) - times
    base = np.zeros(size + 1, np.int64)  # where the ranks of a length begin
    if len(rows):
        begin = np.concatenate(([True], lengths[1:] != lengths[:-1]))
        base[lengths[begin]] = starts[begin]
    return base, starts, first, offset


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    """texts -> lists of ids by the vocabulary file.

    Where a byte-level BPE file gives its merges in the order of their ids, rank-based encoding yields the same ids several
    times faster; it is used for such files, except for texts over a million characters, whose white space its matcher may
    not take.
    """
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)

    def plain(texts: list[str]) -> list[list[int]]:
        return [x.ids for x in model.encode_batch(texts, add_special_tokens=False)]

    ranks = _byte_ranks(path)
    if ranks is None:
        return plain
    import tiktoken

    fast = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks[0], special_tokens=ranks[1])
    return lambda texts: [fast.encode(t, allowed_special="all") if len(t) <= 1_000_000 else plain([t])[0] for t in texts]


#: Fixed value: how byte-level BPE splits text before its merges.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """(bytes -> id, special token -> id) if ranks say the same as the file's merges, else None."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    added = spec.get("added_tokens", [])
    simple = all(x["special"] and not any(x[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for x in added)
    if model.get("type") != "BPE" or spec.get("normalizer") or not (plain and level and simple):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(shown)))}
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [vocab["".join(pair)] for pair in pairs]
    special = {x["content"]: x["id"] for x in added}
    merged = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
    if order != sorted(order) or len(merged) != 256 + len(order):
        return None
    return merged, special


def pieces_of(ids: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ids) of each piece; longer documents are cut from the end, so that the first piece may be shorter."""
    first = len(ids) % size or size
    yield 0, ids[:first]
    for at in range(first, len(ids), size):
        yield at, ids[at : at + size]


def tokenise(
    df: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", size: int = 1024, end: int | None = 2,
    keep_ids: bool = True, zipped: bool = False,
) -> DataFrame:
    """Pieces of at most ``size`` tokens: doc_id, piece, start, length, ids_crc32, ids (binary, little-endian unsigned
    32-bit; compressed if ``zipped``; null without ``keep_ids``), and the task and rank in it by which ``pack`` numbers the pieces."""
    id_type = df.schema[doc_id].dataType
    schema = T.StructType(
        [T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
         T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType()),
         T.StructField("task", T.IntegerType()), T.StructField("rank", T.LongType())]
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(vocabulary)
        task = TaskContext.get().partitionId()
        stored = zstandard.ZstdCompressor(level=1).compress if zipped else bytes
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64]
                rows = []
                for key, ids in zip(part["doc_id"], encode([t or "" for t in part["text"]]), strict=True):
                    own = np.array(ids if end is None else [*ids, end], "<u4")
                    if not len(own):
                        continue
                    for n, (start, piece) in enumerate(pieces_of(own, size)):
                        raw = piece.tobytes()
                        rows.append((key, n, start, len(piece), zlib.crc32(raw), stored(raw) if keep_ids else None, task, int(seen[len(piece)])))
                        seen[len(piece)] += 1
                yield pd.DataFrame({f.name: pd.Series([r[i] for r in rows], dtype=object) for i, f in enumerate(schema)})

    return df.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text")).mapInPandas(cut, schema)


def pack(
    df: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", size: int = 1024, end: int | None = 2,
    keep_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset.

    Pieces of a sequence lie gapless from offset 0.  A null text is empty: it still has its end token.  Equal rows are
    packed as often as they stand.  Without an end token, documents without tokens have no piece.  An empty table packs
    into nothing.
    """
    # ids stand compressed in what is written and shuffled in between
    made = materialise(tokenise(df, vocabulary, doc_id, text, size, end, keep_ids, zipped=True), "pieces")
    per_task = made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("task", "length", "before")
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    base, starts, first, offset = _slots(plan_bins(histogram, size), size)

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        spot = base[lengths.to_numpy(np.int64)] + ranks.to_numpy(np.int64)
        run = np.searchsorted(starts, spot, side="right") - 1
        return pd.DataFrame({"sequence_id": first[run] + spot - starts[run], "offset": offset[run]})

    @F.pandas_udf("binary")
    def plain(values: pd.Series) -> pd.Series:
        opened = zstandard.ZstdDecompressor().decompress
        return values.map(lambda v: None if v is None else opened(v))

    ids = plain("ids") if keep_ids else F.col("ids")
    ranked = made.join(offsets, ["task", "length"])
    return ranked.withColumn("__place", place("length", F.col("rank") + F.col("before"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", ids.alias("ids"), "__place.sequence_id", "__place.offset"
    )
