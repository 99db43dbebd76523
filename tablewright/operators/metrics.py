"""Quality measures over prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import labels
from tablewright.functions.columns import ratio, rows_as_table
from tablewright.operators.ordinal import CHUNK_ROWS, running


MAX_LABELS = 1_000


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """n, MAE, RMSE and R2 in one pass.  R2 is 1 or 0 when the actual values are constant."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    both = y.isNotNull() & p.isNotNull()
    error = F.when(both, y - p)
    facts = df.groupBy(*by).agg(
        F.count(error).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.var_pop(F.when(both, y)).alias("spread"),
    )
    r2 = F.when(F.col("spread") > 0, 1 - F.col("mse") / F.col("spread")).otherwise(F.when(F.col("mse") == 0, 1.0).otherwise(0.0))
    return facts.select(*by, "n", "mae", F.sqrt("mse").alias("rmse"), F.when(F.col("n") > 0, r2).alias("r2"))


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Actual by predicted counts over all label pairs, zeros included.

    Counting comes first; the label grid is built from the distinct labels of the counts.
    """
    counted = df.filter(F.col(actual).isNotNull()).groupBy(_text(actual).alias("actual"), _text(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    both = counted.select(F.explode(F.array("actual", "predicted")).alias("label")).distinct()
    if both.limit(MAX_LABELS + 1).count() > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    names = both.agg(F.collect_set("label").alias("l"))  # size checked above
    grid = names.select(F.explode("l").alias("actual"), "l").select("actual", F.explode("l").alias("predicted"))
    return grid.join(counted, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def largest_confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Right and wrong counts and the most common mistake."""
    counted = df.groupBy(_text(actual).alias("a"), _text(predicted).alias("p")).agg(F.count("*").alias("n"))
    wrong = F.col("a") != F.col("p")
    mistake = F.min_by(F.struct("a", "p", "n"), F.when(wrong, F.struct((-F.col("n")).alias("n"), "a", "p")))
    facts = counted.agg(F.sum("n").alias("total"), F.sum(F.when(wrong, 0).otherwise(F.col("n"))).alias("correct"), mistake.alias("m"))
    return facts.select(
        "total",
        "correct",
        (F.col("total") - F.col("correct")).alias("errors"),
        ratio(F.col("correct"), F.col("total")).alias("accuracy"),
        F.coalesce(F.col("m.a"), F.lit("none")).alias("mistaken"),
        F.coalesce(F.col("m.p"), F.lit("none")).alias("taken_for"),
        F.coalesce(F.col("m.n"), F.lit(0)).alias("mistakes"),
    )


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class; division by zero counts as 0."""
    counted = df.filter(F.col(actual).isNotNull()).groupBy(_text(actual).alias("a"), _text(predicted).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("a").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"), hit.cast("long").alias("hit")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"), F.lit(0).cast("long").alias("hit")),
    )
    long = counted.select(F.explode(sides).alias("s")).select("s.*").filter("label IS NOT NULL")
    per = long.groupBy("label").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit"))
    safe = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    per = per.withColumn("precision", safe(F.col("hit"), F.col("called"))).withColumn("recall", safe(F.col("hit"), F.col("support")))
    f1 = safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return per.withColumn("f1", f1).select("label", "precision", "recall", "f1", "support", "hit")


def classification_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    per = class_report(df, actual, predicted)
    weighted = lambda c: ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    return per.agg(
        F.sum("support").alias("n"),
        ratio(F.sum("hit"), F.sum("support")).alias("accuracy"),
        weighted("precision").alias("precision"),
        weighted("recall").alias("recall"),
        weighted("f1").alias("f1"),
    )


def _score_counts(df: DataFrame, actual: str, scores: dict[str, str]) -> DataFrame:
    """(class, score, positives, negatives): equal scores collapse before the shuffle."""
    cells = F.array(*[F.struct(F.lit(c).alias("class"), F.col(s).cast("double").alias("score")) for c, s in scores.items()])
    long = df.filter(F.col(actual).isNotNull()).select(_text(actual).alias("a"), F.explode(cells).alias("s"))
    hit = F.col("a") == F.col("s.class")
    return (
        long.groupBy(F.col("s.class").alias("class"), F.col("s.score").alias("score"))
        .agg(F.count(F.when(hit, 1)).alias("pos"), F.count(F.when(~hit, 1)).alias("neg"))
        .filter("score IS NOT NULL")
    )


def roc_auc(df: DataFrame, actual: str, scores: dict[str, str], chunk: int = CHUNK_ROWS) -> DataFrame:
    """Exact one-vs-rest area per class, from rank counts; classes without both sides are left out.

    A pair of a positive and a negative counts 1 when ordered, a half when tied.
    """
    counted = _score_counts(df, actual, scores)
    below = running(counted, ["class"], ["score"], sums={"neg_upto": "neg"}, chunk=chunk)
    wins = F.col("pos").cast("double") * (F.col("neg_upto") - F.col("neg") / 2)
    per = below.groupBy("class").agg(F.sum(wins).alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return per.filter("p > 0 AND n > 0").select("class", (F.col("w") / (F.col("p").cast("double") * F.col("n"))).alias("auc"), F.col("p").alias("support"))


def weighted_auc(df: DataFrame, actual: str, scores: dict[str, str], **how) -> DataFrame:
    """Support-weighted mean of the one-vs-rest areas (one score: the plain binary area)."""
    return roc_auc(df, actual, scores, **how).agg(ratio(F.sum(F.col("auc") * F.col("support")), F.sum("support")).alias("auc"))


def roc_curve(df: DataFrame, actual: str, scores: dict[str, str], chunk: int = CHUNK_ROWS) -> DataFrame:
    """(class, threshold, fpr, tpr), one point per distinct score."""
    counted = _score_counts(df, actual, scores).withColumn("_down", -F.col("score"))
    summed = running(counted, ["class"], ["_down"], sums={"tp": "pos", "fp": "neg"}, chunk=chunk)
    totals = counted.groupBy("class").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).filter("p > 0 AND n > 0")
    joined = summed.join(totals, "class")
    return joined.select("class", F.col("score").alias("threshold"), ratio(F.col("fp"), F.col("n")).alias("fpr"), ratio(F.col("tp"), F.col("p")).alias("tpr"))


def diagnosis(train: Column, test: Column) -> Column:
    """Name for the train/test behaviour of a model."""
    gap = train - test
    return (
        F.when(train.isNull() | test.isNull(), "Model failed")
        .when((train >= 0.70) & (gap >= 0.10), "Overfitting risk")
        .when((train < 0.45) & (test < 0.45), "Underfitting risk")
        .when((test < 0) & (train > 0), "Poor generalization")
        .otherwise("Reasonable fit")
    )


def adjusted_score(test: Column, gap: Column, cv_std: Column) -> Column:
    """Test score less half the positive gap and a quarter of the validation spread."""
    return test - 0.5 * F.greatest(gap, F.lit(0.0)) - 0.25 * F.coalesce(cv_std, F.lit(0.0))


def diagnose_scores(scores: DataFrame) -> DataFrame:
    """Gap, diagnosis and adjusted score for a table of (model, train_score, test_score, cv_std)."""
    gap = F.col("train_score") - F.col("test_score")
    return scores.withColumns(
        {
            "gap": gap,
            "diagnosis": diagnosis(F.col("train_score"), F.col("test_score")),
            "adjusted_score": adjusted_score(F.col("test_score"), gap, F.col("cv_std")),
        }
    )


def champion(diagnosed: DataFrame) -> DataFrame:
    """Best model with a reasonable fit, else the best of the others, flagged as not safe."""
    valid = diagnosed.filter(F.col("test_score").isNotNull() & (F.col("diagnosis") != "Model failed"))
    safe = F.col("diagnosis") == "Reasonable fit"
    order = [safe.desc(), F.col("adjusted_score").desc_nulls_last(), F.abs("gap"), F.col("model")]
    return valid.orderBy(*order).limit(1).withColumn("safe", safe.cast("int").cast("long"))


def best_by(evaluation: DataFrame, metric: str) -> DataFrame:
    return evaluation.orderBy(F.col(metric).desc_nulls_last(), "model").limit(1)


def prediction_summary(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Means, gap, error shares of the mean and a quality word."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    base = df.filter(y.isNotNull() & p.isNotNull())
    error = y - p
    facts = base.agg(
        F.count("*").alias("n"),
        F.avg(y).alias("actual_mean"),
        F.avg(p).alias("predicted_mean"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - ratio(F.avg(error * error), F.var_pop(y))).alias("r2"),
    )
    gap = F.col("predicted_mean") - F.col("actual_mean")
    return facts.withColumns(
        {
            "mean_gap": gap,
            "direction": F.when(gap > 0, "over-predicts").when(gap < 0, "under-predicts").otherwise("matches the mean"),
            "mae_share": F.abs(ratio(F.col("mae"), F.col("actual_mean"))),
            "rmse_share": F.abs(ratio(F.col("rmse"), F.col("actual_mean"))),
            "quality": labels.r2_label(F.col("r2")),
        }
    )


def metric_labels(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """(metric, score, quality) for 0-1 scores held in one row."""
    cells = [(F.lit(n), F.round(n, 3), labels.quality_label(F.round(n, 3))) for n in names]
    return rows_as_table(metrics, cells, ["metric", "score", "quality"])
