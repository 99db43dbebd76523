"""Benchmark decontamination with SimHash windows, in DataFrame functions only.

Windows of a document that have an item's size get a SimHash of their word shingles, and fingerprints look up the items of
their size in a multi-index: eight blocks of eight bits.  A fingerprint within the radius differs from its item in one block by
at most an eighth of the radius, so the index holds every item under each block's neighbours up to that distance, and the lookup
finds all items within the radius.  Candidates are verified by the exact weighted similarity of their shingles.

Windows that cannot reach the similarity get no fingerprint: with ``own`` shingles in the window and ``m`` in the item, a
similarity of s takes s / (1 + s) * (own + m) common ones, so windows with fewer places whose shingle is the item's are left out.
All others are taken, wherever in the item their shingles stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import col, materialise

LANES = 32  # bit b and bit b + 32 are counted in the two halves of one long


def words_column(text: Column) -> Column:
    """Lower-case runs of letters and digits; one empty word for null or a text without any."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def shingle_hashes(words: Column, size: int) -> Column:
    """A hash of each run of ``size`` words, by place."""

    def hashed(single: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(single) - size), lambda i: F.xxhash64(*[F.get(single, i + n) for n in range(size)]))
        return F.when(F.size(single) >= size, runs).otherwise(F.array().cast("array<bigint>"))

    # ``words`` stands here once, so that it is computed once: an outer array binds the hashes of the single words
    return F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), hashed)[0]


def _shingle_text(words: Column, at: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, at + 1, size), " ")


def simhash_column(hashes: Column) -> list[Column]:
    """Aggregates that count the set bits of ``hashes``, two to a long."""
    pair = F.lit(1 << 32 | 1)
    return [F.sum(F.shiftrightunsigned(hashes, b).bitwiseAND(pair)).alias(f"l{b}") for b in range(LANES)]


def fingerprint_from(total: Column) -> Column:
    """The majority bits from the counts of ``simhash_column``."""
    half = F.lit((1 << 32) - 1)
    value = F.lit(0).cast("long")
    for b in range(LANES):
        low, high = F.col(f"l{b}").bitwiseAND(half), F.shiftrightunsigned(F.col(f"l{b}"), 32)
        value = value.bitwiseOR(F.when(2 * low > total, F.lit(1 << b)).otherwise(F.lit(0)).cast("long"))
        top = 1 << (b + 32)
        value = value.bitwiseOR(F.when(2 * high > total, F.lit(top if top < 1 << 63 else top - (1 << 64)).cast("long")).otherwise(F.lit(0).cast("long")))
    return value


BLOCKS, WIDTH = 8, 8  # blocks of a fingerprint and their bits


def _blocks(prints: DataFrame, away: int = 0) -> DataFrame:
    """One row for each block of ``fp``: its number ``way`` and each ``value`` at most ``away`` bits from the block's."""
    parts = [F.shiftrightunsigned("fp", n * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)) for n in range(BLOCKS)]
    rows = prints.select("*", F.posexplode(F.array(*parts)).alias("way", "value"))
    flips = [m for m in range(1 << WIDTH) if m.bit_count() <= away]
    return rows.withColumn("value", F.explode(F.transform(F.array(*[F.lit(m) for m in flips]), lambda m: F.col("value").bitwiseXOR(m)))) if away else rows


def _fingerprints(shingles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fp) from one row per shingle with its hash h."""
    sums = shingles.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *simhash_column(F.col("h")))
    return sums.select(*keys, fingerprint_from(F.col("total")).alias("fp"))


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    shingle: int = 5, similarity: float = 0.8, radius: int = 23,
) -> DataFrame:
    """One row for each document and benchmark item with a window of the item's size whose shingles are similar enough:
    doc_id, item_id, start (word of the best window, the first of equal ones), n_words, similarity (weighted Jaccard; the weight
    of a shingle is how often it stands there).

    Words are lower-case runs of letters and digits.  An item with fewer words than a shingle is one shingle; without words,
    or null, it matches nothing, nor does such a document.  Documents shorter than an item are one window.  Equal texts are
    searched once and all returned; rows that repeat an id are all returned; items that repeat count each.
    """
    known = items.select(col(item_id).alias("item_id"), words_column(col(item_text).cast("string")).alias("iw")).where(F.col("iw")[0] != "")
    known = known.withColumn("n", F.size("iw")).withColumn("k", F.least(F.lit(shingle), F.col("n"))).withColumn("m", F.col("n") - F.col("k") + 1)
    known = materialise(known.withColumn("item", F.monotonically_increasing_id()), "items")
    sizes = sorted(r["k"] for r in known.select("k").distinct().collect())  # at most `shingle` numbers
    base = docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
    keyed = base.withColumn("t", F.xxhash64("text", F.length("text")))
    if not sizes:
        return keyed.join(known, F.lit(False)).select("doc_id", "item_id", F.lit(0).alias("start"), F.col("n").alias("n_words"), F.lit(0.0).alias("similarity"))

    item_rows = None
    for k in sizes:
        own = known.where(F.col("k") == k)
        rows = own.select("item", "n", "k", "m", F.posexplode(shingle_hashes(F.col("iw"), k)).alias("q", "h"))
        item_rows = rows if item_rows is None else item_rows.unionByName(rows)
    item_rows = materialise(item_rows, "item_shingles")

    pairs = None
    for k in sizes:
        hashed = keyed.select("t", shingle_hashes(words_column(F.col("text")), k).alias("hs"))
        places = hashed.select("t", (F.size("hs") + k - 1).alias("size"), F.posexplode("hs").alias("p", "h"))
        hits = places.join(item_rows.where(F.col("k") == k), "h")
        # copies of a text fall together before anything is counted
        shared = hits.groupBy("t", "item", "n", "m", "size").agg(F.array_sort(F.collect_set("p")).alias("at")).withColumn("k", F.lit(k))
        own = F.least(F.col("m"), F.col("size") - k + 1)
        shared = shared.withColumn("need", F.ceil(F.lit(similarity / (1 + similarity)) * (own + F.col("m")) - 1e-6).cast("int"))
        enough = shared.where(F.size("at") >= F.col("need"))
        pairs = enough if pairs is None else pairs.unionByName(enough)

    def holding(j: Column) -> Column:
        """Windows that hold the places from the one ``need`` before up to the j-th."""
        low, high = F.get("at", j - F.col("need")), F.get("at", j - 1)
        last = F.greatest(F.col("size") - F.col("n"), F.lit(0))
        reach = F.sequence(F.greatest(F.lit(0), high - F.col("m") + 1), F.least(last, low))
        return F.when(high - low < F.col("m"), reach).otherwise(F.array().cast("array<int>"))

    starts = F.array_distinct(F.flatten(F.transform(F.sequence(F.col("need"), F.size("at")), holding)))
    pairs = materialise(pairs.select("t", "n", "k", "m", F.explode(starts).alias("s")).distinct(), "pairs")

    # Spark measures the pairs: few texts with many of an item's shingles are broadcast to the documents, many are joined by key
    texts = keyed.join(pairs.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.min("text").alias("text"))
    texts = materialise(texts.select("t", words_column(F.col("text")).alias("w")), "leak_texts")
    windows = None
    for k in sizes:
        hashed = texts.select("t", "w", shingle_hashes(F.col("w"), k).alias("hs"))
        rows = pairs.where(F.col("k") == k).join(hashed, "t")
        rows = rows.select("t", "n", "k", "s", F.slice("hs", F.col("s") + 1, F.col("m")).alias("hs"), F.slice("w", F.col("s") + 1, F.col("n")).alias("w"))
        windows = rows if windows is None else windows.unionByName(rows)
    windows = materialise(windows, "windows")

    key = ["t", "n", "s"]
    prints = _fingerprints(windows.select(*key, F.explode("hs").alias("h")), key)
    index = _blocks(_fingerprints(item_rows.select("item", "n", "h"), ["item", "n"]), radius // BLOCKS).withColumnRenamed("fp", "ip")
    near = _blocks(prints).join(index, ["n", "way", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ip"))) <= radius)
    candidates = near.select(*key, "item").distinct()

    def spelled(words: Column, size: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: _shingle_text(words, i, size))

    inside = windows.join(candidates, key).select("t", "item", "s", F.size("hs").alias("own"), F.explode(spelled(F.col("w"), F.col("k"))).alias("sh"))
    of_item = known.select("item", "m", F.explode(spelled(F.col("iw"), F.col("k"))).alias("sh")).groupBy("item", "m", "sh").agg(F.count(F.lit(1)).alias("ci"))
    counted = inside.groupBy("t", "item", "s", "own", "sh").agg(F.count(F.lit(1)).alias("cw"))
    common = counted.join(of_item, ["item", "sh"]).groupBy("t", "item", "s", "own", "m").agg(F.sum(F.least("cw", "ci")).alias("both"))
    alike = common.withColumn("similarity", F.col("both") / (F.col("own") + F.col("m") - F.col("both"))).where(F.col("similarity") >= similarity)
    best = alike.groupBy("t", "item").agg(F.max(F.struct(F.col("similarity"), (-F.col("s")).alias("s"))).alias("b"))
    found = materialise(best.select("t", "item", (-F.col("b.s")).alias("start"), F.col("b.similarity").alias("similarity")), "leaks")
    named = found.join(known.select("item", "item_id", F.col("n").alias("n_words")), "item")
    return keyed.select("doc_id", "t").join(named, "t").select("doc_id", "item_id", "start", "n_words", "similarity")
