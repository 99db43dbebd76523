"""Quality and toxicity classifier by co-training of two views.

The text view sees which of the most telling terms (words, their beginnings and endings) a document has; the metadata view
sees its source, language and size.  Each is a logistic regression.  In each round both label all unlabelled documents, and what one view is sure
of (by its calibrated probability) becomes training data of the other.  In the end each view is calibrated on labelled rows
that took no part in training, and the two calibrated log-odds are combined against the base rate to score all documents.

Only the labelled rows of the fits are a sample of bounded size (``Settings``): terms are counted over all labelled rows, all
unlabelled documents take part in every round, and every document is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import col, materialise


@dataclass(frozen=True)
class Settings:
    """Bounds of the samples and sizes of the models."""

    labelled_rows: int = 20_000
    calibration_share: int = 5  # one of so many labelled rows calibrates
    rounds: int = 2
    sure: float = 0.97
    terms: int = 400  # for each target
    least_rows: int = 5  # labelled rows that must have a term
    iterations: int = 25
    penalty: float = 1e-3


def _bucket(id_column: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(id_column.cast("string"), F.lit("quality")), F.lit(parts))


def _sampled(df: DataFrame, rows: int, wanted: int) -> DataFrame:
    """About ``wanted`` of the ``rows`` rows, by hash of doc_id."""
    share = min(1_000_000, int(1_000_000 * wanted / max(rows, 1)) + 1)
    return df if rows <= wanted else df.where(_bucket(F.col("doc_id"), 1_000_000) < share)


def text_terms(text: Column) -> Column:
    """Distinct words of letters in lower case, their first five letters, the last two characters of words as written, and
    the shares of capitals and of characters that are neither letters nor blanks, in twentieths."""
    whole = F.coalesce(text, F.lit(""))
    words = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(whole), r"[^\p{L}]+", " ")), " "))
    written = F.array_distinct(F.split(F.trim(whole), r"\s+"))
    starts = F.array_distinct(F.transform(words, lambda w: F.concat(F.lit("^"), F.substring(w, 1, 5))))
    ends = F.array_distinct(F.transform(written, lambda w: F.concat(F.lit("$"), F.right(w, F.lit(2)))))
    capitals, marks = F.regexp_count(whole, F.lit(r"\p{Lu}")), F.regexp_count(whole, F.lit(r"[^\p{L}\s]"))
    shares = [F.concat(F.lit(f"%{name}="), F.floor(20 * n / (F.char_length(whole) + 1)).cast("string")) for name, n in (("capitals", capitals), ("marks", marks))]
    return F.concat(words, starts, ends, F.array(*shares))


def metadata_terms(source: Column, lang: Column, chars: Column) -> Column:
    size = F.floor(F.log2(F.coalesce(chars, F.lit(0)) + 1)).cast("string")
    return F.array(F.concat(F.lit("source="), F.coalesce(source, F.lit("?"))), F.concat(F.lit("lang="), F.coalesce(lang, F.lit("?"))), F.concat(F.lit("size="), size))


def _with_terms(df: DataFrame) -> DataFrame:
    meta = metadata_terms(F.col("source"), F.col("lang"), F.char_length(F.col("text")))
    return df.withColumn("text_terms", text_terms(F.col("text"))).withColumn("meta_terms", meta).drop("text", "source", "lang")


#: So many labelled documents (an id and a few numbers each) are sent to all tasks; more meet their texts by a join on the id.
SENT_LABELS = 500_000


def term_counts(labelled: DataFrame, targets: tuple[str, ...]) -> DataFrame:
    """For each term and target the labelled rows that have it (<target>_m) and their sum of labels (<target>_a)."""
    sums = [c for t in targets for c in (F.count(t).cast("double").alias(f"{t}_m"), F.sum(t).alias(f"{t}_a"))]
    # the outer form: a plain explode would have its terms computed for a filter below the join, too
    return labelled.select(F.explode_outer("text_terms").alias("term"), *targets).groupBy("term").agg(*sums)


def telling_terms(counted: DataFrame, labels: DataFrame, target: str, settings: Settings) -> list[str]:
    """The terms whose presence says most about the target (log-likelihood ratio), at most ``settings.terms``."""
    total = labels.agg(F.count(target).alias("n"), F.coalesce(F.sum(target), F.lit(0.0)).alias("p")).first()
    n, p = float(total["n"]), float(total["p"])
    if not 0 < p < n:
        return []
    counts = counted.select("term", F.col(f"{target}_m").alias("m"), F.col(f"{target}_a").alias("a"))
    a, m = F.col("a"), F.col("m")

    def part(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    ratio = part(a, m * p / n) + part(m - a, m * (n - p) / n) + part(p - a, (n - m) * p / n) + part(n - p - m + a, (n - m) * (n - p) / n)
    best = counts.where(m >= settings.least_rows).withColumn("g", ratio).orderBy(F.desc("g"), "term").limit(settings.terms)
    return [r["term"] for r in best.select("term").collect()]


def _with_views(df: DataFrame, vocabulary: list[str]) -> DataFrame:
    known = CountVectorizerModel.from_vocabulary(vocabulary or [""], inputCol="text_terms", outputCol="text_view")
    made = known.setBinary(True).setMinTF(0.0).transform(df)
    return HashingTF(inputCol="meta_terms", outputCol="meta_view", numFeatures=4096, binary=True).transform(made).drop("text_terms", "meta_terms")


VIEWS = ("text", "meta")


@dataclass
class View:
    """A fitted view: log-odds a * margin + b."""

    model: LogisticRegressionModel | None
    a: float
    b: float

    def log_odds(self, df: DataFrame, view: str, name: str) -> DataFrame:
        if self.model is None:
            return df.withColumn(name, F.lit(self.b))
        model = self.model.copy()
        model.setFeaturesCol(f"{view}_view").setRawPredictionCol("__raw").setProbabilityCol("__p").setPredictionCol("__c")
        made = model.transform(df)
        return made.withColumn(name, vector_to_array("__raw")[1] * self.a + self.b).drop("__raw", "__p", "__c")


def platt(margin: np.ndarray, label: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b of the log-odds a * margin + b by Newton steps, with Platt's softened targets."""
    positive, negative = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    beta = np.array([0.0, np.log((positive + 1) / (negative + 1))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        slope = x.T @ (p - target) + np.array([1e-6, 1e-6]) * beta
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def _fit(rows: DataFrame, view: str, held: DataFrame, settings: Settings) -> View:
    """Fit on rows (label, <view>_view) and calibrate on held; a constant where one class is missing."""
    classes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(classes) < 2:
        n, positive = sum(classes.values()), classes.get(1.0, 0)
        return View(None, 0.0, float(np.log((positive + 1) / (n - positive + 1))))
    model = LogisticRegression(featuresCol=f"{view}_view", labelCol="label", regParam=settings.penalty, maxIter=settings.iterations, tol=1e-5).fit(rows)
    raw = View(model, 1.0, 0.0).log_odds(held, view, "margin").select("margin", "label").toPandas()  # a share of the labelled sample
    if not len(raw):
        return View(model, 1.0, 0.0)
    return View(model, *platt(raw["margin"].to_numpy(float), raw["label"].to_numpy(float)))


def co_train(labelled: DataFrame, pool: DataFrame, settings: Settings) -> dict[str, View]:
    """Both views from labelled rows (doc_id, label, views) and an unlabelled pool (doc_id, views)."""
    held = labelled.where(_bucket(F.col("doc_id"), settings.calibration_share) == 0)
    own = labelled.where(_bucket(F.col("doc_id"), settings.calibration_share) != 0)
    given: dict[str, DataFrame | None] = dict.fromkeys(VIEWS)
    fitted: dict[str, View] = {}
    edge = float(np.log(settings.sure / (1 - settings.sure)))
    for step in range(settings.rounds + 1):
        for view in VIEWS:
            rows = own.select("label", f"{view}_view")
            if given[view] is not None:
                rows = rows.unionByName(given[view])
            fitted[view] = _fit(rows, view, held, settings)
        if step == settings.rounds:
            break
        scored = fitted["meta"].log_odds(fitted["text"].log_odds(pool, "text", "by_text"), "meta", "by_meta")
        for view, teacher in (("text", "by_meta"), ("meta", "by_text")):
            sure = scored.where(F.abs(teacher) >= edge)
            given[view] = sure.select((F.col(teacher) > 0).cast("double").alias("label"), f"{view}_view")
    return fitted


def score(
    docs: DataFrame, labels: DataFrame, targets: tuple[str, ...] = ("quality", "toxic"), settings: Settings = Settings()  # noqa: B008
) -> DataFrame:
    """One row per document: doc_id, and for each target <target>_text, <target>_meta and <target> (probabilities).

    ``docs`` has doc_id, text, source and lang; ``labels`` has doc_id and the targets as 0/1.  Several labels of a document
    are averaged and rounded up; null labels count for nothing, null text is empty, null source and lang are values of their
    own.  Without labels a target has the probability 0.5 everywhere; with one class only, its smoothed share.
    """
    rows = docs.select("doc_id", col("text").cast("string").alias("text"), col("source").cast("string").alias("source"), col("lang").cast("string").alias("lang"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(*[(F.avg(t) >= 0.5).cast("double").alias(t) for t in targets])
    # at most twice `labelled_rows` short rows: the hash takes that many of them with certainty for practical purposes
    labelled_documents = known.count()
    chosen = _sampled(known, labelled_documents, settings.labelled_rows)
    near = F.broadcast(known) if labelled_documents <= SENT_LABELS else known
    counted = materialise(term_counts(_with_terms(rows.join(near, "doc_id")), targets), "terms")
    labels_there = rows.select("doc_id").join(known, "doc_id")
    vocabulary = sorted({t for target in targets for t in telling_terms(counted, labels_there, target, settings)})
    made = materialise(_with_views(_with_terms(rows), vocabulary), "views")
    labelled = materialise(made.join(F.broadcast(chosen), "doc_id").coalesce(8), "labelled")
    pool = materialise(made.join(known.select("doc_id"), "doc_id", "left_anti"), "pool")

    for target in targets:
        own = labelled.where(F.col(target).isNotNull()).withColumn("label", F.col(target))
        share = own.agg(F.avg("label").alias("p"), F.count("label").alias("n")).first()
        n, p = share["n"], share["p"] or 0.0
        prior = float(np.log((n * p + 1) / (n * (1 - p) + 1)))
        views = co_train(own.select("doc_id", "label", *[f"{v}_view" for v in VIEWS]), pool, settings)
        for view in VIEWS:
            made = views[view].log_odds(made, view, f"__{target}_{view}")
        both = F.col(f"__{target}_text") + F.col(f"__{target}_meta") - F.lit(prior)
        odds = {f"{target}_text": F.col(f"__{target}_text"), f"{target}_meta": F.col(f"__{target}_meta"), target: both}
        for name, value in odds.items():
            made = made.withColumn(name, 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), value)))))
    return made.select("doc_id", *[c for t in targets for c in (f"{t}_text", f"{t}_meta", t)])
