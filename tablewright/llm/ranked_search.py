"""Ranked lexical search by NRA: impact-sorted lists read in order, a lower and an upper score for every document seen.

A shard of documents holds, for every query term, the list of its documents by falling impact.  All lists of a query are
read forward together.  What a document has shown so far is its lower score; the upper score adds, for each list that has
not shown it, the impact the list stands at.  Reading goes on until no document outside the first k can still enter them,
ties by id included, and until the scores of the first k are exact.  Lists are only ever read forward, nothing is looked up.
The k best so far of earlier shards of a task are the threshold of later ones; the tasks' lists are merged at the end.

Defined handling: a null or empty text has no terms and is never found, a query without terms finds nothing.  Documents that
repeat an id or a text are documents of their own; a null id comes after all ids among equal scores, equal ids come in any
order.  Queries that repeat an id are ranked each for itself.  Empty tables give no rows.  Columns besides id and text are
not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import arrow_rows, col, materialise, session_of

#: Query terms that are held in every task at once; more queries go through the documents in further rounds.
TERMS = 200_000
#: A shard is full at so many list entries or documents.
ENTRIES, DOCUMENTS = 1_000_000, 16_384
#: The first stretch of every list that is read; each further one is twice as long.
STRETCH = 64

#: ASCII without letters and digits parts terms; all else, beyond ASCII too, belongs to them.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_TABLE = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))


def terms_of(text: str | None) -> list[bytes]:
    """All terms in order, A-Z lower-cased."""
    return text.encode().lower().translate(_TABLE).split() if text else []


def impacts(tf: np.ndarray, norm: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """What an entry adds to a score."""
    return weight * ((1_000_000_000 * tf) // (1_000 * tf + 8 * norm))


class Shard:
    """The lists of some documents, each by falling impact."""

    def __init__(self, document: np.ndarray, term: np.ndarray, impact: np.ndarray, count: int, terms: int):
        order = np.lexsort((-impact, term))
        self.document, self.impact = document[order], impact[order]
        self.begin = np.searchsorted(term[order], np.arange(terms + 1))
        self.count = count

    def search(self, query: list[tuple[int, int]], place: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents that can be among the first ``k`` and do not score below ``least``, with their exact scores.

        ``query`` has terms with their repeats; ``place`` orders documents of equal scores.  More than ``k`` come back only
        where a score equals ``least``."""
        lists = [(int(self.begin[t]), int(self.begin[t + 1]), n) for t, n in query if self.begin[t] < self.begin[t + 1]]
        lower = np.zeros(self.count, dtype=np.int64)
        unseen = np.ones((self.count, len(lists)), dtype=bool)
        at = [begin for begin, _, _ in lists]
        stretch = STRETCH
        left: np.ndarray | None = None  # once no unseen document can enter, only these are followed
        while True:
            frontier = np.zeros(len(lists), dtype=np.int64)
            for i, (_, end, n) in enumerate(lists):
                if at[i] == end:
                    continue
                stop = min(end, at[i] + stretch)
                shown = self.document[at[i] : stop]
                lower[shown] += n * self.impact[at[i] : stop]
                unseen[shown, i] = False
                at[i] = stop
                frontier[i] = n * self.impact[stop] if stop < end else 0
            stretch *= 2
            seen = np.flatnonzero(lower) if left is None else left
            low = lower[seen]
            order = np.lexsort((place[seen], -low))[:k]
            bar = (least, -1)
            if len(order) == k and int(low[order[-1]]) >= least:
                bar = (int(low[order[-1]]), int(place[seen[order[-1]]]))
            if left is None and int(frontier.sum()) >= bar[0] and frontier.any():
                continue  # a document that no list has shown can still enter
            upper = low + unseen[seen] @ frontier if frontier.any() else low
            stays = (upper > bar[0]) | ((upper == bar[0]) & ((bar[1] < 0) | (place[seen] <= bar[1])))
            left = seen[stays]
            if (upper[stays] == low[stays]).all():
                return left, lower[left]


def _vocabulary(queries: list[Counter]) -> dict[bytes, int]:
    known: dict[bytes, int] = {}
    for query in queries:
        for term in query:
            known.setdefault(term, len(known))
    return known


def _rounds(rows: Iterator, limit: int) -> Iterator[list[tuple[object, Counter]]]:
    """Queries in groups of about ``limit`` different terms."""
    held: list[tuple[object, Counter]] = []
    size = 0
    for item, text in rows:
        terms = Counter(terms_of(text))
        if terms:
            held.append((item, terms))
            size += len(terms)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _counted(docs: DataFrame, id_col: str, text_col: str, known: dict[bytes, int]) -> DataFrame:
    """Per document with a term: its id, its number of terms, and the query terms it holds with their numbers."""
    shared = session_of(docs).sparkContext.broadcast(known)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = shared.value.get
        for batch in batches:
            ids, sizes, terms, tfs = [], [], [], []
            for place, text in enumerate(batch["text"]):
                words = terms_of(text)
                if not words:
                    continue
                found, tf = np.unique(np.array([v for v in map(get, words) if v is not None], dtype=np.int32), return_counts=True)
                ids.append(place)
                sizes.append(len(words))
                terms.append(found)
                tfs.append(tf.astype(np.int32))
            yield pd.DataFrame({"id": batch["id"].iloc[ids].to_numpy(), "no_id": batch["no_id"].iloc[ids].to_numpy(), "n": sizes, "terms": pd.Series(terms, dtype=object), "tfs": pd.Series(tfs, dtype=object)})

    narrow = docs.select(F.coalesce(col(id_col).cast("long"), F.lit(0)).alias("id"), col(id_col).isNull().alias("no_id"), col(text_col).alias("text"))
    return narrow.mapInPandas(count, "id long, no_id boolean, n long, terms array<int>, tfs array<int>")


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", k: int = 10, terms: int = TERMS) -> DataFrame:
    """The ``k`` best documents of every query: item_id, rank (from 1), doc_id, score; only scores above 0.

    Documents are read once for each group of queries with ``terms`` different terms, the bound of what tasks hold of the
    queries.  What is written are the counts of query terms; shards are cut from them inside the tasks, and at most ``k``
    documents of a query leave a task.
    """
    spark = session_of(docs)
    made: DataFrame | None = None
    rows = ((r["item"], r["text"]) for r in queries.select(col(item_col).cast("long").alias("item"), col(query_col).alias("text")).toLocalIterator())
    for group in _rounds(rows, terms):
        known = _vocabulary([q for _, q in group])
        with arrow_rows(spark, 1_000):
            counted = materialise(_counted(docs, id_col, text_col, known), "terms")
        total = counted.agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L")).first()
        if not total["N"]:
            continue
        df = dict(counted.select(F.explode_outer("terms").alias("t")).groupBy("t").count().where("t IS NOT NULL").toLocalIterator())
        ratio = (2.0 * total["N"] + 2.0) / (2.0 * np.array([df.get(t, 0) for t in range(len(known))], dtype=np.float64) + 1.0)
        weights = np.floor(1000.0 * np.log(ratio)).astype(np.int64)
        items = [(item, [(known[t], n) for t, n in query.items()]) for item, query in group]
        with arrow_rows(spark, 1_000):
            part = materialise(_ranked(counted, items, weights, total["N"], total["L"], k), "ranked")
        made = part if made is None else made.unionByName(part)
    if made is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return made.select("item_id", "rank", "doc_id", "score")


def _ranked(counted: DataFrame, items: list, weights: np.ndarray, N: int, L: int, k: int) -> DataFrame:
    """The best of every task, then of all tasks."""
    shared = session_of(counted).sparkContext.broadcast((items, weights))

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, entries, documents = [], 0, 0
        for batch in batches:
            sizes = batch["terms"].map(len).to_numpy()
            begin = 0
            for end in range(1, len(batch) + 1):
                entries, documents = entries + int(sizes[end - 1]), documents + 1
                if entries >= ENTRIES or documents >= DOCUMENTS:
                    yield pd.concat([*held, batch.iloc[begin:end]], ignore_index=True)
                    held, entries, documents, begin = [], 0, 0, end
            held.append(batch.iloc[begin:])
        if documents:
            yield pd.concat(held, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, weights = shared.value
        none = np.empty(0, dtype=np.int64)
        best = [(none, none, none)] * len(items)  # score, no id, id of the first k documents of each query
        for rows in shards(batches):
            sizes = rows["terms"].map(len).to_numpy()
            term = np.concatenate(rows["terms"].to_list()).astype(np.int64)
            tf = np.concatenate(rows["tfs"].to_list()).astype(np.int64)
            norm = 100 - 75 + (75 * rows["n"].to_numpy(np.int64) * N) // L
            document = np.repeat(np.arange(len(rows)), sizes)
            shard = Shard(document, term, impacts(tf, norm[document], weights[term]), len(rows), len(weights))
            ids, no_id = rows["id"].to_numpy(np.int64), rows["no_id"].to_numpy(bool).astype(np.int64)
            place = np.empty(len(rows), dtype=np.int64)
            place[np.lexsort((ids, no_id))] = np.arange(len(rows))
            for i, (_, query) in enumerate(items):
                least = int(best[i][0][-1]) if len(best[i][0]) == k else 1
                at, score = shard.search(query, place, k, least)
                if len(at):
                    score, lacks, known = (np.concatenate(x) for x in zip(best[i], (score, no_id[at], ids[at]), strict=True))
                    first = np.lexsort((known, lacks, -score))[:k]
                    best[i] = score[first], lacks[first], known[first]
        for i, (item, _) in enumerate(items):
            score, lacks, known = best[i]
            if len(score):
                yield pd.DataFrame({
                    "query": i, "item_id": pd.array([item] * len(score), dtype="Int64"),
                    "doc_id": pd.arrays.IntegerArray(known, lacks.astype(bool)), "score": score,
                })

    found = counted.mapInPandas(run, "query int, item_id long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
