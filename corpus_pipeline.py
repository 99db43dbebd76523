"""From raw documents to packed training sequences, in stages that each work on all that the one before kept."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablewright.llm import decontaminate, language_id, packing, simhash, suffix_dedup  # noqa: E402
from tablewright.llm.common import materialise  # noqa: E402
from tablewright.llm.queries import read, vocabulary  # noqa: E402

#: Below this score no language is near (0: nothing in common with any profile, 1: the profile itself).
LEAST_SCORE = 0.2


def _small_batches(spark: SparkSession) -> None:
    """Whole texts are large rows: a thousand of them make a batch for Python, not ten thousand."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the known languages; the profiles come from the labelled rows of the stage's own input.

    Texts without a letter, and those far from every profile, go.
    """
    _small_batches(spark)
    profiles = language_id.learn_profiles(docs)
    judged = language_id.identify(docs, profiles, prediction="__lang", score="__score")
    return judged.where((F.col("__lang") != language_id.UNKNOWN) & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by SimHash (three-word shingles, at most three differing bits)."""
    _small_batches(spark)
    return simhash.keep_one_per_group(docs, shingle=3, radius=3)


#: Repeated byte strings of this length go: a passage of fifty words is longer (with words of four letters and their blanks).
REPEAT_BYTES = 240


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of REPEAT_BYTES that stand anywhere else too; n_chars follows the text.

    Of a character that loses some of its bytes the others go as well.  Documents of which nothing is left go."""

    made = suffix_dedup.remove_repeats(docs, length=REPEAT_BYTES)
    left = made.where((F.col("n_removed") == 0) | (F.col("kept_text") != ""))
    size = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("text", F.col("kept_text")).withColumn("n_chars", size).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is similar to a benchmark item (five-word shingles, similarity 0.8).

    Only the text decides: all rows of a leaking text go, those with a null id too, and other rows of the same id stay."""
    keyed = docs.withColumn("__text", F.xxhash64("text", F.length("text")))
    found = decontaminate.find_leaks(keyed.select("__text", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"), doc_id="__text")
    leaks = materialise(found.select(F.col("doc_id").alias("__text")).distinct(), "leaked")
    return keyed.join(leaks, "__text", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 1024 tokens: one row per piece with its place."""
    _small_batches(spark)
    return packing.pack(docs, vocabulary(), size=1024, end=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identified),
    ("simhash_near_dedup", distinct),
    ("suffix_array_dedup", without_repeats),
    ("benchmark_decontamination", decontaminated),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs


#: Tokens, SimHash and suffix order have no SQL; the stages are tested against brute force.
ORACLE_SQL = None
