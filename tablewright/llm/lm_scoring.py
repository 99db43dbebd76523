"""Katz back-off scoring of documents by a bigram model with Good-Turing discounts.

``p(w|h)`` is the discounted relative frequency of the bigram where it was seen in training, else ``alpha(h) * p(w)``, and
``p(w)`` is the discounted relative frequency of the word, or for a word that was never seen all that the discounts leave.
Each history, and the whole training text, has one event more than counted; its share always goes to what was not seen, so
that every ``alpha`` is defined and all probabilities of a history sum to one.

Texts are tokenised once into chunks of a bounded number of tokens.  Words and bigrams are 64-bit hashes.  A chunk sends
each of its distinct n-grams once to the partition of the count table that owns its hash range, and gets its total back, so
a frequent word is one entry a chunk and no partition grows hot.  Each distinct bigram has one owner among the chunks, which
adds it to the figures of its history; these give alpha, which the chunks with unseen bigrams after that history ask for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import arrow_rows, col, materialise, words_of

END, BEGIN = 1, 2  # reserved hashes
LEVELS = 5  # counts up to here are discounted
CHUNK_TOKENS = 1_000_000
BUCKET_KEYS = 400_000


# --- packed arrays -------------------------------------------------------------------------------------------------------


def _pack(a: np.ndarray) -> bytes:
    """Byte planes, compressed: the many zero bytes of small numbers cost next to nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def _unpack(blob: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(blob)), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def _pack_keys(sorted_keys: np.ndarray) -> bytes:
    return _pack(np.diff(sorted_keys, prepend=np.uint64(0)))


def _unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, np.uint64), dtype=np.uint64)


def _edges(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the keys of each bucket, an equal share of all hashes, begin; one more for the end."""
    cuts = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(sorted_keys, cuts), [len(sorted_keys)]))


# --- model ---------------------------------------------------------------------------------------------------------------


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """d[0..LEVELS]: the share that a count keeps, from the numbers of n-grams with count 1, 2, ... LEVELS + 1.

    Good-Turing with Katz's correction, which leaves larger counts alone; with as many levels as give shares in (0, 1).  Where
    no level does (too little text, or counts that do not fall), half an event is taken off each count up to LEVELS.
    """
    n = [0, *counts_of_counts]
    for top in range(min(LEVELS, len(n) - 2), 0, -1):
        if min(n[1 : top + 2]) <= 0:
            continue
        common = (top + 1) * n[top + 1] / n[1]
        kept = np.array([((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if common != 1 else -1.0 for r in range(1, top + 1)])
        if ((kept > 0) & (kept < 1)).all():
            return np.concatenate(([1.0], kept, np.ones(LEVELS - top)))
    return np.concatenate(([1.0], [(r - 0.5) / r for r in range(1, LEVELS + 1)]))


class Unigrams:
    """Probabilities of words by their counts."""

    def __init__(self, total: int, distinct: int, counts_of_counts: list[int]):
        self.total, self.distinct = total, distinct
        self.keep = discounts(counts_of_counts)
        taken = sum(n * r * (1 - self.keep[r]) for r, n in enumerate(counts_of_counts[:LEVELS], 1))
        self.unseen = (1 + taken) / (total + 1)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        kept = np.where(counts <= LEVELS, self.keep[np.minimum(counts, LEVELS)], 1.0)
        return np.where(counts > 0, kept * counts / (self.total + 1), self.unseen)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def covered(self, classes: np.ndarray, large: np.ndarray) -> np.ndarray:
        """Summed probability of sets of words: how many have count 1..LEVELS, and the summed larger counts."""
        weights = self.keep[1:] * np.arange(1, LEVELS + 1)
        return (classes @ weights + large) / (self.total + 1)


def _bigram_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right + np.uint64(0x7FB5D329728EA185))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(32))


class Chunk:
    """The tokens of some texts: local word numbers, and which of them are scored (all but the context of each segment)."""

    def __init__(self, vocabulary: bytes, tokens: bytes, sizes: list[int], train: list[bool]):
        self.words = _unpack_keys(vocabulary)
        ids = _unpack(tokens, np.uint32)
        sizes = np.asarray(sizes, np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1  # the context token of each segment
        scored = np.ones(len(ids), bool)
        scored[first] = False
        at = np.flatnonzero(scored)
        self.segment = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.train = np.asarray(train, bool)[self.segment]
        self.left, self.right = ids[at - 1], ids[at]
        del at, scored, ids
        pairs, pair = np.unique(self.left.astype(np.uint64) << np.uint64(32) | self.right, return_inverse=True)
        pairs = pairs.view(np.int64)
        keys = _bigram_keys(self.words[pairs >> 32], self.words[pairs & 0xFFFFFFFF])
        order = np.argsort(keys)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.pairs, self.keys, self.pair = pairs[order], keys[order], place[pair]

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.right[self.train], minlength=len(self.words))

    def history_counts(self) -> np.ndarray:
        return np.bincount(self.left[self.train], minlength=len(self.words))

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair[self.train], minlength=len(self.pairs))


def _chunks(df: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, text, train) as chunks; a long text may go on in further chunks, with its last word as context."""
    key = df.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("chunk", T.LongType()), T.StructField("row", T.ArrayType(T.LongType())), T.StructField("doc_id", T.ArrayType(key)),
         T.StructField("train", T.ArrayType(T.BooleanType())), T.StructField("size", T.ArrayType(T.LongType())),
         T.StructField("vocabulary", T.BinaryType()), T.StructField("tokens", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        total, rows, chunks = 0, 0, 0

        def flushed() -> pd.DataFrame:
            words, ids = np.unique(np.concatenate([h[3] for h in held]), return_inverse=True)
            values = (task + chunks, [h[0] for h in held], [h[1] for h in held], [h[2] for h in held], [len(h[3]) - 1 for h in held],
                      _pack_keys(words), _pack(ids.astype(np.uint32)), len(words), len(ids))
            return pd.DataFrame({f.name: pd.Series([v], dtype=object) for f, v in zip(schema, values, strict=True)})

        for batch in batches:
            for doc, text, train in zip(batch["doc_id"].tolist(), batch["text"], batch["train"], strict=True):
                words = words_of(text)
                tokens = np.empty(len(words) + 2, np.uint64)
                tokens[0], tokens[-1] = BEGIN, END
                tokens[1:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
                for at in range(0, len(tokens) - 1, size):
                    part = tokens[at : at + size + 1]
                    held.append((task + rows, doc, bool(train), part))
                    total += len(part)
                    if total >= size:
                        yield flushed()
                        held, total, chunks = [], 0, chunks + 1
                rows += 1
        if held:
            yield flushed()

    return df.mapInPandas(made, schema)


def _open(row) -> Chunk:
    return Chunk(row["vocabulary"], row["tokens"], row["size"], row["train"])


def _requests(batches: Iterator[pd.DataFrame], buckets: dict[int, int]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.to_dict("records"):
            chunk = _open(row)
            for order, keys, counts in ((1, chunk.words, chunk.word_counts()), (2, chunk.keys, chunk.pair_counts())):
                edges = _edges(keys, buckets[order])
                rows = [(order, b, row["chunk"], _pack_keys(keys[x:y]), _pack(counts[x:y].astype(np.uint32))) for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x]
                yield pd.DataFrame(rows, columns=["order", "bucket", "chunk", "keys", "counts"])


def _counted(group: pd.DataFrame) -> pd.DataFrame:
    """A partition of the count table, its counts of counts, and the answers to the chunks that asked."""
    group = group.sort_values("chunk")
    keys = [_unpack_keys(k) for k in group["keys"]]
    own = np.concatenate([_unpack(c, np.uint32) for c in group["counts"]]).astype(np.int64)
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, own, minlength=len(distinct)).astype(np.int64)
    seen = np.flatnonzero(own > 0)
    owner = np.zeros(len(own), np.uint8)
    owner[seen[np.unique(back[seen], return_index=True)[1]]] = 1  # the first chunk with the key in training
    order, bucket = int(group["order"].iloc[0]), int(group["bucket"].iloc[0])
    ends = np.cumsum([len(k) for k in keys])
    rows = []
    for chunk, end, n in zip(group["chunk"].tolist(), ends.tolist(), map(len, keys), strict=True):
        part = slice(end - n, end)
        rows.append((order, bucket, chunk, None, _pack(total[back[part]].astype(np.uint64)), _pack(owner[part]), None))
    kept = total > 0
    levels = np.bincount(np.minimum(total[kept], LEVELS + 2), minlength=LEVELS + 3)[1 : LEVELS + 2]
    stats = [int(total.sum()), int(kept.sum()), *levels.tolist()]
    rows.append((order, bucket, -1, _pack_keys(distinct[kept]), _pack(total[kept].astype(np.uint64)), None, stats))
    return pd.DataFrame(rows, columns=["order", "bucket", "chunk", "keys", "counts", "owner", "stats"])


COUNTED = "order int, bucket int, chunk long, keys binary, counts binary, owner binary, stats array<long>"


def _answered(answers: list, order: int, field: str, kind: type) -> np.ndarray:
    """What the partitions answered about all keys of a chunk, in the order of the keys."""
    own = sorted((a for a in answers if a["order"] == order), key=lambda a: a["bucket"])
    return np.concatenate([_unpack(a[field], kind) for a in own]) if own else np.empty(0, kind)


def _classes(counts: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """For each group the numbers of counts 1..LEVELS, and the sum of the larger ones."""
    small = np.zeros((groups, LEVELS), np.int64)
    low = (counts > 0) & (counts <= LEVELS)
    np.add.at(small, (group[low], counts[low] - 1), 1)
    large = np.bincount(group[counts > LEVELS], counts[counts > LEVELS], minlength=groups).astype(np.int64)
    return small, large


def _evaluated(batches: Iterator[pd.DataFrame], words: Unigrams, keep: np.ndarray, buckets: int, key_name: str) -> Iterator[pd.DataFrame]:
    """Sums of each segment but for alpha; what each owned bigram adds to its history; what is still to be scored."""
    for batch in batches:
        for row in batch.to_dict("records"):
            chunk = _open(row)
            answers = list(row["answers"])
            word_count = _answered(answers, 1, "counts", np.uint64).astype(np.int64)
            pair_count = _answered(answers, 2, "counts", np.uint64).astype(np.int64)
            owned = _answered(answers, 2, "owner", np.uint8).astype(bool)
            left, right = chunk.pairs >> 32, chunk.pairs & 0xFFFFFFFF
            followed = np.where(chunk.words == BEGIN, row["texts"], word_count)  # each word of a text is followed by one more
            history = followed[left]
            single = words.probability(word_count)
            seen = pair_count > 0
            kept = np.where(pair_count <= LEVELS, keep[np.minimum(pair_count, LEVELS)], 1.0)
            p = np.where(seen, kept * pair_count / (history + 1), single[right])
            n = len(row["row"])
            sums = lambda per_token: np.bincount(chunk.segment, per_token, minlength=n)
            open_pair = ~seen & (history > 0)
            yield _framed(
                {"kind": ["part"] * n, "row": list(row["row"]), key_name: list(row["doc_id"]), "train": list(row["train"]), "n_tokens": list(row["size"]),
                 "n_known": sums((word_count[chunk.right] > 0).astype(float)).astype(np.int64), "base": sums(words.base(word_count)[chunk.right]),
                 "score": sums(np.log10(p)[chunk.pair])}
            , key_name)
            small, _ = _classes(pair_count[owned], left[owned], len(chunk.words))
            lower, large = _classes(word_count[right[owned]], left[owned], len(chunk.words))
            asked = np.zeros(len(chunk.words), bool)
            asked[left[open_pair]] = True
            listed = np.flatnonzero(asked | (small.any(1)) | lower.any(1) | (large > 0))
            edges = _edges(chunk.words[listed], buckets)
            rows = []
            for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if y > x:
                    h = listed[x:y]
                    figures = np.concatenate([small[h], lower[h], large[h, None], followed[h, None], asked[h, None]], 1)
                    rows.append({"kind": "history", "bucket": b, "chunk": row["chunk"], "keys": _pack_keys(chunk.words[h]), "figures": _pack(figures.T.ravel().astype(np.uint64))})
            events = np.flatnonzero(open_pair[chunk.pair])
            if len(events):
                of, where = np.unique(chunk.left[events], return_inverse=True)
                of_segment = chunk.segment[events]
                rows.append({"kind": "rest", "chunk": row["chunk"], "keys": _pack_keys(chunk.words[of]), "figures": _pack(np.concatenate([where, of_segment]).astype(np.uint32)), "rows": list(row["row"])})
            if rows:
                yield _framed({k: [r.get(k) for r in rows] for k in FIELDS}, key_name)


FIELDS = ["kind", "row", "train", "n_tokens", "n_known", "base", "score", "bucket", "chunk", "keys", "figures", "rows"]


def _framed(values: dict[str, list], key_name: str) -> pd.DataFrame:
    """All columns of the result, None where a kind of row has no value."""
    n = len(values["kind"])
    return pd.DataFrame({c: pd.Series([None] * n if values.get(c) is None else list(values[c]), dtype=object) for c in (*FIELDS[:2], key_name, *FIELDS[2:])})


def _alphas(group: pd.DataFrame, words: Unigrams, keep: np.ndarray) -> pd.DataFrame:
    """A partition of the table of back-off weights (log10), and the weights that each chunk asked for."""
    keys = [_unpack_keys(k) for k in group["keys"]]
    width = 2 * LEVELS + 3
    figures = np.concatenate([_unpack(f, np.uint64).reshape(width, -1).T for f in group["figures"]]).astype(np.int64)
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros((len(distinct), width - 2), np.int64)
    np.add.at(total, back, figures[:, :-2])
    times = np.zeros(len(distinct), np.int64)
    np.maximum.at(times, back, figures[:, -2])
    taken = total[:, :LEVELS] @ (np.arange(1, LEVELS + 1) * (1 - keep[1:]))
    left = (1 + taken) / (times + 1)
    rest = 1 - words.covered(total[:, LEVELS : 2 * LEVELS], total[:, 2 * LEVELS])
    alpha = np.log10(left / rest)
    asked = figures[:, -1] > 0
    ends = np.cumsum([len(k) for k in keys])
    bucket = int(group["bucket"].iloc[0])
    rows = [(bucket, -1, _pack_keys(distinct), _pack(alpha))]
    for chunk, end, own in zip(group["chunk"].tolist(), ends.tolist(), keys, strict=True):
        part = slice(end - len(own), end)
        if asked[part].any():
            rows.append((bucket, chunk, None, _pack(alpha[back[part]][asked[part]])))
    return pd.DataFrame(rows, columns=["bucket", "chunk", "keys", "alpha"])


def _closed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.to_dict("records"):
            alpha = np.concatenate([_unpack(a["alpha"], np.float64) for a in sorted(row["answers"], key=lambda a: a["bucket"])])
            where, segment = _unpack(row["figures"], np.uint32).reshape(2, -1)
            rows = np.asarray(row["rows"], np.int64)
            added = np.bincount(segment, alpha[where], minlength=len(rows))
            hit = np.unique(segment)
            yield pd.DataFrame({"row": rows[hit], "score": added[hit]})


def fit_and_score(
    df: DataFrame, train: str, doc_id: str = "doc_id", text: str = "text", chunk_tokens: int = CHUNK_TOKENS, bucket_keys: int = BUCKET_KEYS
) -> DataFrame:
    """One row per row: doc_id, train, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).

    The model learns from the rows whose ``train`` is true.  Tokens are words in lower case (A-Z) and one end per text; a
    null text has only its end.  Repeated rows count each time.  Without training rows all words are unseen.  An empty table
    gives an empty result.  The count table (order, bucket, keys, counts) and the table of back-off weights lie in the shared
    folder, in partitions by hash range.
    """
    rows = df.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"), F.coalesce(col(train), F.lit(False)).alias("train"))
    key = rows.schema["doc_id"].dataType
    with arrow_rows(df.sparkSession, 500):
        chunks = materialise(_chunks(rows, chunk_tokens), "chunks")
    size = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("w"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()
    buckets = {1: max(1, size["w"] // bucket_keys), 2: max(1, size["t"] // bucket_keys)}

    with arrow_rows(df.sparkSession, 4):
        asked = chunks.mapInPandas(lambda b: _requests(b, buckets), "order int, bucket int, chunk long, keys binary, counts binary")
        table = materialise(asked.groupBy("order", "bucket").applyInPandas(_counted, COUNTED), "counts")
        stats = {r["order"]: r for r in table.where("chunk = -1").groupBy("order").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(LEVELS + 3)]).collect()}
        figures = {o: [int(stats[o][f"s{i}"] or 0) for i in range(LEVELS + 3)] if o in stats else [0] * (LEVELS + 3) for o in (1, 2)}
        words = Unigrams(figures[1][0], figures[1][1], figures[1][2:])
        keep = discounts(figures[2][2:])
        first = chunks.select(F.explode(F.arrays_zip("row", "train")).alias("x")).where("x.train").select("x.row").distinct().count()

        answers = table.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("order", "bucket", "counts", "owner")).alias("answers"))
        joined = chunks.join(answers, "chunk").withColumn("texts", F.lit(first))
        fields = T.StructType(
            [T.StructField("kind", T.StringType()), T.StructField("row", T.LongType()), T.StructField("doc_id", key), T.StructField("train", T.BooleanType()),
             T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType()),
             T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("figures", T.BinaryType()),
             T.StructField("rows", T.ArrayType(T.LongType()))]
        )
        made = materialise(joined.mapInPandas(lambda b: _evaluated(b, words, keep, buckets[1], "doc_id"), fields), "evaluated")
        history = made.where("kind = 'history'").select("bucket", "chunk", "keys", "figures")
        weights = materialise(history.groupBy("bucket").applyInPandas(lambda g: _alphas(g, words, keep), "bucket int, chunk long, keys binary, alpha binary"), "backoff")
    got = weights.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "alpha")).alias("answers"))
    rest = made.where("kind = 'rest'").select("chunk", "figures", "rows").join(got, "chunk").mapInPandas(_closed, "row long, score double")
    parts = made.where("kind = 'part'").select("row", "doc_id", "train", "n_tokens", "n_known", "base", "score")
    blank = [F.lit(None).cast(parts.schema[c].dataType).alias(c) for c in ("doc_id", "train", "n_tokens", "n_known", "base")]
    both = parts.unionByName(rest.select("row", "score", *blank))
    total = both.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("train").alias("train"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum("score").alias("score"),
    )
    return total.select("doc_id", "train", "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score")
