"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams of a language by rank.  A document's own ranking is compared with each profile
by out-of-place distance: the sum of the differences in rank, with the profile's length for an n-gram that it lacks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewright.llm.common import col

UNKNOWN = "und"
BITS = 18  # an index among the letters of Unicode fits


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> 1-based index among letters, 0 for anything else."""
    flags = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(flags, np.cumsum(flags), 0).astype(np.int64)


def ngram_counts(text: str | None, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the 1- to ``longest``-grams of the lower-cased letters; words are padded with one blank."""
    empty = np.empty(0, np.int64)
    if not text:
        return empty, empty
    codes = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not codes.any():
        return empty, empty
    codes = np.concatenate(([0], codes, [0]))
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    found = [codes[codes != 0] | (1 << 3 * BITS)]
    for n in range(2, longest + 1):
        size = len(codes) - n + 1
        if size <= 0:
            break
        key = np.zeros(size, np.int64)
        keep = np.ones(size, bool)
        for i in range(n):
            part = codes[i : i + size]
            key = (key << BITS) | part
            if 0 < i < n - 1:
                keep &= part != 0
        if n == 2:
            keep &= key != 0
        found.append(key[keep] | (n << 3 * BITS))
    return np.unique(np.concatenate(found), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent keys, ties by key."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


def learn_profiles(
    labelled: DataFrame, text: str = "text", label: str = "lang", size: int = 400, longest: int = 3, labels: int = 2000
) -> pd.DataFrame:
    """Profiles (label, key, rank) of all labelled rows.  Rows without a text or label teach nothing.

    Tasks count their own rows and shuffle distinct n-grams only.  The result has at most ``size`` rows a label; more than
    ``labels`` labels are an error, so what is returned to the driver is bounded by size * labels rows.
    """
    if not 1 <= longest <= 3:
        raise ValueError("n-grams of 1 to 3 characters")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[list, list, int]] = {}

        def flushed(name: str) -> pd.DataFrame:
            keys, counts, _ = held.pop(name)
            got, back = np.unique(np.concatenate(keys), return_inverse=True)
            return pd.DataFrame({"label": name, "key": got, "n": np.bincount(back, np.concatenate(counts)).astype(np.int64)})

        for batch in batches:
            for value, name in zip(batch["text"], batch["label"], strict=True):
                keys, counts = ngram_counts(value, longest)
                k, c, n = held.setdefault(name, ([], [], 0))
                k.append(keys)
                c.append(counts)
                held[name] = (k, c, n + len(keys))
                if held[name][2] > 3_000_000:
                    yield flushed(name)
        for name in list(held):
            yield flushed(name)

    rows = labelled.select(col(text).cast("string").alias("text"), col(label).cast("string").alias("label")).dropna()
    counts = rows.mapInPandas(count, "label string, key long, n long").groupBy("label", "key").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("label").orderBy(F.desc("n"), "key")
    top = counts.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < size).drop("n")
    found = top.limit(size * labels + 1).toPandas()
    if len(found) > size * labels:
        raise ValueError(f"more than {labels} labels")
    return found.sort_values(["label", "rank"]).reset_index(drop=True)


def _matrix(profiles: pd.DataFrame, size: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    names = sorted(profiles["label"].unique())
    keys = np.unique(profiles["key"].to_numpy(np.int64))
    ranks = np.full((len(keys), len(names)), size, np.int64)
    where = np.searchsorted(keys, profiles["key"].to_numpy(np.int64))
    ranks[where, [names.index(x) for x in profiles["label"]]] = profiles["rank"].to_numpy(np.int64)
    return names, keys, ranks


def identify(
    df: DataFrame, profiles: pd.DataFrame, text: str = "text", size: int = 400, longest: int = 3,
    prediction: str = "lang_pred", score: str = "score",
) -> DataFrame:
    """All rows of ``df`` with the nearest label and a score from 0 (no n-gram in common) to 1 (same ranking).

    Null or letterless text, or no profiles at all: label ``und``, score 0.  Equal distances: the smaller label.
    No shuffle.  Columns of ``df`` that have the names of the new ones are replaced.
    """
    names, keys, ranks = _matrix(profiles, size)

    @F.pandas_udf(T.StructType([T.StructField("p", T.StringType()), T.StructField("s", T.DoubleType())]))
    def nearest(texts: pd.Series) -> pd.DataFrame:
        labels, scores = [], []
        for value in texts:
            found, counts = ngram_counts(value, longest)
            if not len(found) or not names:
                labels.append(UNKNOWN)
                scores.append(0.0)
                continue
            own = ranked(found, counts, size)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            places = np.where((keys[at] == own)[:, None], ranks[at], size)
            apart = np.abs(places - np.arange(len(own))[:, None])
            apart[places == size] = size
            total = apart.sum(0)
            best = int(total.argmin())
            labels.append(names[best])
            scores.append(1.0 - float(total[best]) / (size * len(own)))
        return pd.DataFrame({"p": labels, "s": scores})

    kept = [c for c in df.columns if c not in (prediction, score)]
    made = df.withColumn("__nearest", nearest(col(text).cast("string")))
    return made.select(*[col(c) for c in kept], F.col("__nearest.p").alias(prediction), F.col("__nearest.s").alias(score))
