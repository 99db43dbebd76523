"""The operators applied to whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import decontaminate, fingerprints, hard_negatives, html_extract, language_id, lm_scoring, packing, quality, ranked_search, sanitise, simhash, suffix_dedup, url_filters
from tablewright.llm.common import fold_of

Query = Callable[[SparkSession, str], DataFrame]
#: The folder of the vocabulary files is a parameter of the packing operator; this is where this machine has them.
TOKENIZERS = "/opt/tokenizers/__init__.py"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json", module: str = TOKENIZERS) -> str:
    """The path of a vocabulary file by the module that lists them."""
    spec = importlib.util.spec_from_file_location("public_tokenizers", module)
    found = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(found)
    return found.path(name)


RULES = [
    url_filters.parse_rule("block", "net/"), url_filters.parse_rule("allow", "example.net/en/"),
    url_filters.parse_rule("block", "example.com/de/"), url_filters.parse_rule("allow", "org/fr/"),
]


def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    made = lm_scoring.fit_and_score(docs.withColumn("train", fold_of("doc_id", 5) != 1), "train")
    return made.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, read(spark, folder, "benchmark").select("item_id", "text"))


def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages").select("page_id", "url")
    return url_filters.judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    made = packing.pack(docs, vocabulary(), size=1024, end=2, keep_ids=False)
    return made.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    made = suffix_dedup.remove_repeats(docs, length=400, keep_text=False)
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages").select("page_id", "url", "html")
    made = html_extract.extract(pages, html_extract.learn_weights(pages))
    return made.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    folds = docs.withColumn("held_out", fold_of("doc_id", 3) == 1)
    profiles = language_id.learn_profiles(folds.where("not held_out"))
    return language_id.identify(folds.drop("lang"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_next(read(spark, folder, "documents").select("doc_id", "text"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_components(read(spark, folder, "documents").select("doc_id", "text"), shingle=3, radius=3)


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    made = quality.score(docs, read(spark, folder, "labels").select("doc_id", "quality", "toxic"))
    return made.withColumn("keep", (F.col("quality") >= 0.5) & (F.col("toxic") < 0.5))


def op11_pii(spark: SparkSession, folder: str) -> DataFrame:
    made = sanitise.sanitise(read(spark, folder, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in range(4)]
    counts = [(F.size(kinds) - left).cast("long").alias(f"n_{sanitise.KINDS[k]}") for k, left in enumerate(counts)]
    digest = F.sha2(sanitise.named(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return made.select("doc_id", *counts, digest, sanitise.named(F.col("spans")).alias("spans"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    table = read(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table, "vec_id", "embedding", label, F.col("vec_id") % 100 == 0)


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return ranked_search.search(docs, read(spark, folder, "benchmark").select("item_id", "text"), k=10)


QUERIES: dict[str, Query] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_decontamination": op2_decontamination,
    "op3_url_filters": op3_url_filters,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_language_id": op7_language_id,
    "op8_fingerprints": op8_fingerprints,
    "op9_simhash": op9_simhash,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_pii": op11_pii,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_ranked_search": op13_ranked_search,
}

#: Words and five-word shingles of a table with an id and a text.
SHINGLES = r"""
        {name}_w AS (
            SELECT id, list_filter(string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
            FROM (SELECT {id} AS id, text FROM {table})
        ), {name}_s AS (
            SELECT id, len(w) AS n, least(5, len(w)) AS k, unnest(range(0, len(w) - least(5, len(w)) + 1)) AS p, w FROM {name}_w WHERE len(w) > 0
        ), {name} AS (SELECT id, n, k, p, array_to_string(w[p + 1 : p + k], ' ') AS sh FROM {name}_s)
"""

CHECKS: dict[str, str] = {
    "op2_decontamination": "WITH "
    + SHINGLES.format(name="d", id="doc_id", table="documents")
    + ", "
    + SHINGLES.format(name="i", id="item_id", table="benchmark")
    + r"""
        , pairs AS (
            SELECT d.id AS doc_id, i.id AS item_id, i.n AS n_words, d.n AS size, i.n - i.k + 1 AS m
            FROM d JOIN i ON d.sh = i.sh AND d.k = i.k GROUP BY ALL HAVING count(DISTINCT d.p) >= 0.8 * (i.n - i.k + 1)
        ), windows AS (
            SELECT doc_id, item_id, n_words, m, unnest(range(0, greatest(size - n_words, 0) + 1)) AS s FROM pairs
        ), inside AS (
            SELECT x.doc_id, x.item_id, x.n_words, x.m, x.s, d.sh, count(*) AS cw
            FROM windows x JOIN d ON d.id = x.doc_id AND d.p >= x.s AND d.p < x.s + x.m GROUP BY ALL
        ), sizes AS (SELECT doc_id, item_id, s, sum(cw) AS own FROM inside GROUP BY ALL),
        wanted AS (SELECT id AS item_id, sh, count(*) AS ci FROM i GROUP BY ALL),
        common AS (
            SELECT doc_id, item_id, n_words, m, s, sum(least(cw, ci)) AS hit FROM inside JOIN wanted USING (item_id, sh) GROUP BY ALL
        ), alike AS (
            SELECT *, hit / (own + m - hit) AS similarity FROM common JOIN sizes USING (doc_id, item_id, s)
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) AS r FROM alike WHERE similarity >= 0.8
        )
        SELECT doc_id, item_id, s::INTEGER AS start, n_words::INTEGER AS n_words, similarity FROM ranked WHERE r = 1
    """,
    "op3_url_filters": r"""
        WITH cut AS (
            SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['host', 'path']) AS p FROM pages
        ), addressed AS (
            SELECT page_id, translate(p.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, p.path AS path FROM cut
        ), rules(verdict, host, path) AS (
            VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
        ), ranked AS (
            SELECT a.page_id, a.host, a.path, r.host || r.path AS rule, coalesce(r.verdict, 'allow') AS verdict,
                   row_number() OVER (PARTITION BY a.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS n
            FROM addressed a LEFT JOIN rules r
              ON (a.host = r.host OR ends_with(a.host, '.' || r.host)) AND starts_with(a.path, r.path)
        )
        SELECT page_id, host, path, rule, verdict FROM ranked WHERE n = 1
    """,
    "op12_hard_negatives": r"""
        WITH q AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scores AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
                   list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
            FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), positives AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
        )
        SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scores USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
        QUALIFY row_number() OVER w <= 10
    """,
    "op13_ranked_search": r"""
        WITH terms AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM documents
        ), asked AS (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark
        ), sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY ALL),
        facts AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes),
        held AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
        weights AS (
            SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM held, facts GROUP BY term, docs
        ), scored AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // words)))))::BIGINT AS score
            FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), facts GROUP BY ALL
        )
        SELECT item_id, (row_number() OVER w)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
        WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 10
    """,
}
