"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

Each distinct piece of a text (line, sentence, or run of words of a long one) has a 64-bit digest that is added to three
cells, each a (count, sum of digests, sum of checks).  Sketches of two versions are subtracted cell by cell: what they share
vanishes.  Peeling takes digests from cells that hold exactly one, until the table is empty; the differing digests are then
known.  If cells remain, both texts are sketched again with more cells.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewright.llm.common import col, materialise

CELLS = 12  # cells of the stored fingerprint, a multiple of 3
LONG = 64  # characters from which a piece is cut further
_ENDS = re.compile(r"(?<=[.!?|])\s+|[\r\n]+")
_MASK = (1 << 64) - 1


def pieces(text: str) -> list[str]:
    """Paragraph lines cut at sentence ends; longer pieces also after every word whose hash is divisible by 8."""
    found = []
    for piece in _ENDS.split(text):
        piece = piece.strip()
        if len(piece) <= LONG:
            found.append(piece)
            continue
        run: list[str] = []
        for word in piece.split():
            run.append(word)
            if xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) % 8 == 0:
                found.append(" ".join(run))
                run = []
        found.append(" ".join(run))
    return [p for p in found if p]


def digests(text: str | None) -> np.ndarray:
    """Sorted digests of the distinct pieces; the n-th copy of a piece counts as a piece of its own."""
    own = [xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) for p in pieces(text)] if text else []
    if not own:
        return np.empty(0, np.uint64)
    keys = np.sort(np.array(own, np.uint64))
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    if not first.all():
        at = np.flatnonzero(first)
        nth = np.arange(len(keys)) - at[np.cumsum(first) - 1]
        keys = np.where(nth > 0, _mix(keys + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), keys)
    return np.unique(keys)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Sketches:
    """A batch of sketches side by side: sketch i has ``cells[i]`` cells from ``begin[i]``."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells.astype(np.int64)
        self.begin = np.cumsum(self.cells) - self.cells
        total = int(self.cells.sum())
        self.count = np.zeros(total, np.int64)
        self.key = np.zeros(total, np.uint64)
        self.check = np.zeros(total, np.uint64)

    def add(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray | int) -> None:
        """Add (sign 1) or take out (sign -1) keys; cell j of a key lies in the j-th third of its owner's table."""
        third = (self.cells[owner] // 3).astype(np.uint64)
        check = _mix(keys ^ np.uint64(0xA0761D6478BD642F))
        signs = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        by = signs.astype(np.uint64)
        for j in range(3):
            spot = _mix(keys + np.uint64(0xE7037ED1A0B428DB * (j + 1) & _MASK)) % third
            at = self.begin[owner] + (spot + np.uint64(j) * third).astype(np.int64)
            np.add.at(self.count, at, signs)
            np.add.at(self.key, at, keys * by)
            np.add.at(self.check, at, check * by)

    def peel(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of differing digests found, whether the table came out empty) for each sketch."""
        owner_of = np.repeat(np.arange(len(self.cells)), self.cells)
        found = np.zeros(len(self.cells), np.int64)
        look = np.flatnonzero(self.count)
        for _ in range(int(self.cells.max(initial=0)) + 1):
            one = look[np.abs(self.count[look]) == 1]
            sign = self.count[one]
            keys = self.key[one] * sign.astype(np.uint64)
            pure = self.check[one] * sign.astype(np.uint64) == _mix(keys ^ np.uint64(0xA0761D6478BD642F))
            one, keys, sign = one[pure], keys[pure], sign[pure]
            if not len(one):
                break
            owner = owner_of[one]
            order = np.lexsort((keys, owner))
            owner, keys, sign = owner[order], keys[order], sign[order]
            new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))
            owner, keys, sign = owner[new], keys[new], sign[new]
            self.add(owner, keys, -sign)
            found += np.bincount(owner, minlength=len(found))
            look = np.flatnonzero(self.count)
        rest = np.bincount(owner_of[(self.count != 0) | (self.key != 0) | (self.check != 0)], minlength=len(found))
        return found, rest == 0

    def packed(self, i: int) -> bytes:
        """Sketch i: counts, digest sums, check sums."""
        own = slice(self.begin[i], self.begin[i] + self.cells[i])
        return self.count[own].astype("<u4").tobytes() + self.key[own].astype("<u8").tobytes() + self.check[own].astype("<u4").tobytes()


def _joined(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in sets], np.int64)
    return np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets) if sets else np.empty(0, np.uint64)


def sketches_of(sets: list[np.ndarray], cells: int = CELLS) -> list[bytes]:
    made = Sketches(np.full(len(sets), cells))
    made.add(*_joined(sets), 1)
    return [made.packed(i) for i in range(len(sets))]


def differences(left: list[np.ndarray], right: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """How many digests differ between each left and right, by subtracting sketches and peeling.

    Starts with ``cells`` cells; where peeling stops early, the next table has half as many cells again as both
    texts have digests, and from there on twice as many.
    """
    n = len(left)
    result = np.zeros(n, np.int64)
    open_rows = np.arange(n)
    size = np.full(n, cells, np.int64)
    bound = np.array([len(a) + len(b) for a, b in zip(left, right, strict=True)], np.int64)
    step = 0
    while len(open_rows):
        work = Sketches(size[open_rows])
        work.add(*_joined([left[i] for i in open_rows]), 1)
        work.add(*_joined([right[i] for i in open_rows]), -1)
        found, done = work.peel()
        result[open_rows[done]] = found[done]
        open_rows = open_rows[~done]
        step += 1
        size = np.maximum(size * 2, 3 * ((bound + 1) // 2 + 8)) if step == 1 else size * 2
        size = -(-size // 3) * 3
    return result


def likeness(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Shared digests over all digests of both, from the recovered difference; 1 for two empty texts."""
    apart = differences(left, right)
    both = np.array([len(a) + len(b) for a, b in zip(left, right, strict=True)], np.int64)
    union = (both + apart) / 2
    return np.where(union > 0, (both - apart) / np.maximum(2 * union, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by as many first ones of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, pieces.

    Rows are compared with their successor by ascending doc_id (equal ids: by text; null ids first), the last with the first.
    Null text is empty; its fingerprint is that of an empty text, and two empty texts have likeness 1.  A single row is its
    own successor.  Texts move once, in ranges of ids; of each range only the first and last row are looked at again.
    """
    schema = T.StructType(
        [T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("n_chars", T.LongType()),
         T.StructField("edited_sha256", T.BinaryType()), T.StructField("fingerprint", T.BinaryType()),
         T.StructField("edited_fingerprint", T.BinaryType()), T.StructField("near_edited", T.DoubleType()),
         T.StructField("near_next", T.DoubleType()), T.StructField("pieces", T.LongType())]
    )
    held = T.StructType([*schema.fields, T.StructField("part", T.IntegerType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def rows_of(ids: list, chain: list[str]) -> dict[str, list]:
        """All figures of the first len(ids) texts of the chain, each followed by the next."""
        texts, n = chain[:-1], len(ids)
        changed = [edited(a, b) for a, b in zip(texts, chain[1:], strict=True)]
        own = [digests(t) for t in chain]
        new = [digests(t) for t in changed]
        return {
            "doc_id": ids, "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in changed],
            "fingerprint": sketches_of(own[:n]), "edited_fingerprint": sketches_of(new),
            "near_edited": likeness(own[:n], new), "near_next": likeness(own[:n], own[1:]), "pieces": [len(x) for x in own[:n]],
        }

    def frame(values: dict[str, list], part: int) -> pd.DataFrame:
        n = len(values["n_chars"])
        return pd.DataFrame({**values, "part": [part] * n, "role": ["done"] * n, "text": [None] * n})

    def edge(key, text: str, part: int, role: str) -> pd.DataFrame:
        return pd.DataFrame([{f.name: None for f in held} | {"doc_id": key, "part": part, "role": role, "text": text}])

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        last = None
        for batch in batches:
            for at in range(0, len(batch), 256):
                ids = batch["doc_id"].iloc[at : at + 256].tolist()
                texts = [t or "" for t in batch["text"].iloc[at : at + 256]]
                if last is None:
                    yield edge(ids[0], texts[0], part, "first")
                else:
                    ids, texts = [last[0], *ids], [last[1], *texts]
                last = ids[-1], texts[-1]
                if len(ids) > 1:
                    yield frame(rows_of(ids[:-1], texts), part)
        if last is not None:
            yield edge(*last, part, "last")

    @F.pandas_udf(T.StructType(schema.fields[1:]))
    def pair(texts: pd.Series, following: pd.Series) -> pd.DataFrame:
        made = [pd.DataFrame(rows_of([None], [a or "", b or ""])) for a, b in zip(texts, following, strict=True)]
        names = [f.name for f in schema.fields[1:]]
        return pd.concat(made)[names].reset_index(drop=True) if made else pd.DataFrame(columns=names)

    dealt = df.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text")).repartitionByRange("doc_id")
    made = materialise(dealt.sortWithinPartitions("doc_id", "text").mapInPandas(within, held), "fingerprints")
    firsts = made.where("role = 'first'").select("part", "text")
    # one number per range: which range stands after which, the first after the last
    order = Window.orderBy("part")
    parts = firsts.select("part").withColumn("next", F.lead("part").over(order)).withColumn("least", F.min("part").over(Window.partitionBy()))
    after = parts.select("part", F.coalesce("next", "least").alias("__next"))
    ends = made.where("role = 'last'").select("doc_id", "text", "part").join(after, "part")
    ends = ends.join(firsts.select(F.col("part").alias("__next"), F.col("text").alias("following")), "__next")
    names = [f.name for f in schema.fields[1:]]
    closing = ends.withColumn("m", pair("text", "following")).select("doc_id", *[F.col(f"m.{c}").alias(c) for c in names])
    both = made.where("role = 'done'").select("doc_id", *names).unionByName(closing)
    binary = {f.name for f in schema if isinstance(f.dataType, T.BinaryType)}
    return both.select(*[F.lower(F.hex(c)).alias(c) if c in binary else F.col(c) for c in both.columns])
