"""Comparing models: one split, many models, validation folds, diagnosis, importance."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions import rules
from tablewright.operators import metrics
from tablewright.operators.models import (
    CLASSIFICATION,
    REGRESSION,
    FeatureStep,
    Fitted,
    advice,
    change_steps,
    fit_change_model,
    fit_features,
    fit_model,
    last_level,
    model_names,
)
from tablewright.operators.ordinal import with_ordinal
from tablewright.operators.selection import cuts
from tablewright.operators.series import Split, chronological_split, event_features, quantile_code, quantile_edges

EVALUATION = (
    "task string, model string, mae double, rmse double, r2 double, accuracy double, precision double, recall double, "
    "f1 double, auc double, train_rows long, test_rows long, test_start string, features long, note string"
)


#: What a model raises that cannot be fitted to the rows at hand.  Lost executors, full disks and the like are no such reason.
FIT_ERRORS = (ValueError, ArithmeticError, np.linalg.LinAlgError, IllegalArgumentException)

#: Fits asked for at once: most of a fit is short jobs or a few tasks, which leave cores to the others.
AT_ONCE = 12


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], object]]) -> list:
    """The results of ``jobs``, in their order, from a few driver threads; the first error ends the rest."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        try:
            return [w.result() for w in waiting]
        except BaseException:
            pool.shutdown(cancel_futures=True)
            raise


def level_labels(df: DataFrame, target: str, name: str = "level", edges: Sequence[float] | None = None, bins: int = 3, **how) -> DataFrame:
    """Low, Medium, High by quantile bins of the table itself, or by given edges; merged edges give fewer bins."""
    cuts = list(edges) if edges is not None else quantile_edges(df, target, bins, **how)
    if cuts[0] is None:
        return df.withColumn(name, F.lit(None).cast("string"))
    if edges is not None:
        cuts = [float("-inf"), *cuts[1:-1], float("inf")]
    names = rules.LEVELS if bins == 3 else [rules.LEVELS[0], rules.LEVELS[-1]]
    return df.withColumn(name, F.get(F.array(*[F.lit(n) for n in names]), quantile_code(F.col(target).cast("double"), cuts)))


def tertile_labels(train: DataFrame, test: DataFrame, target: str, name: str = "level", edges_from: str = "each", **how) -> tuple[DataFrame, DataFrame]:
    """Classes for both parts.  By default each part is binned by its own edges; ``edges_from="train"`` avoids that leak."""
    if edges_from == "train":
        edges = quantile_edges(train, target, 3, **how)
        return level_labels(train, target, name, edges), level_labels(test, target, name, edges)
    return level_labels(train, target, name, **how), level_labels(test, target, name, **how)


def supervised_frame(df: DataFrame, target: str, features: Sequence[str], task: str, **how) -> DataFrame:
    """Rows with a target; for classes a numeric target is cut into at most three bins."""
    known = df.select(target, *features).filter(F.col(target).isNotNull())
    if task == REGRESSION:
        return known
    distinct = known.select(target).distinct().limit(4).count()
    if distinct <= 1:
        return known.filter(F.lit(False)).withColumn("level", F.lit(None).cast("string"))
    return level_labels(known, target, "level", bins=min(3, distinct), **how).filter("level IS NOT NULL")


def _prepare(df: DataFrame, target: str, features: Sequence[str], date_col: str, windows, start: str) -> tuple[DataFrame, list[str]]:
    made, names = event_features(df, date_col, windows, start)
    all_features = list(dict.fromkeys([*features, *names]))
    return made.filter(F.col(target).isNotNull()), all_features


def evaluate_all_models(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    date_col: str,
    tiebreak: Sequence[str],
    task: str = REGRESSION,
    models: Sequence[str] | None = None,
    params: dict[str, dict] | None = None,
    scaler: str | None = "standard",
    windows=rules.EVENT_WINDOWS,
    start: str = rules.EVENT_START,
    resume: str = rules.EVENT_RESUME,
    key: str | None = None,
    seed: int = 0,
    keys: Sequence[str] = (),
    grain: str | None = None,
) -> DataFrame:
    """Every model on one chronological split; a model that fails becomes a row with a note.

    Numbers are predicted by change models along each series (``keys``, ``grain``),
    classes are quantile levels of the target.
    """
    order = [date_col, *tiebreak]
    keep = list(dict.fromkeys([*keys, *order, target, *features, *([key] if key else [])]))
    ready, names = _prepare(df.select(*keep), target, features, date_col, windows, start)
    split = chronological_split(ready, date_col, tiebreak, start=start, resume=resume)
    steps = None
    train = ready.filter(split.train).persist(StorageLevel.MEMORY_AND_DISK)
    test = ready.filter(~split.train).persist(StorageLevel.MEMORY_AND_DISK)
    rows = []
    try:
        goal = target
        if task == CLASSIFICATION:
            train, test = tertile_labels(train, test, target)
            train, test, goal = train.persist(), test.persist(), "level"
        else:
            steps = change_steps(train, target, order, keys, grain)
            level = last_level(train, target, order, keys)
        prepared = fit_features(steps.rows if task == REGRESSION else train, names, scaler)  # shared by all models
        for name in models or model_names(task):
            row = {"task": task, "model": name, "train_rows": split.train_rows, "test_rows": split.test_rows, "test_start": split.test_start, "features": len(names)}
            try:
                setup = {"step": prepared, "params": (params or {}).get(name), "key": key, "seed": seed}
                if task == REGRESSION:
                    scored = fit_change_model(steps, names, name, **setup).predict(test, level, order, keys, grain)
                    row.update(metrics.regression_metrics(scored, target, "prediction").drop("n").first().asDict())
                else:
                    fitted = fit_model(train, goal, names, name, task, **setup)
                    scored = fitted.predict(test)
                    row.update(metrics.classification_metrics(scored, goal, "prediction").drop("n").first().asDict())
                    if fitted.classes:
                        area = metrics.weighted_auc(scored, goal, {c: f"score_{c}" for c in fitted.classes})
                        row["auc"] = area.first()["auc"]
                row["note"] = "ok"
            except FIT_ERRORS as error:
                row["note"] = f"Model failed: {type(error).__name__}: {str(error)[:200]}"
            rows.append(row)
    finally:
        train.unpersist()
        test.unpersist()
        if steps is not None:
            steps.rows.unpersist()
    names_in_order = [part.split()[0] for part in EVALUATION.split(", ")]
    made = [tuple(row.get(n) for n in names_in_order) for row in rows]
    return df.sparkSession.createDataFrame(made, EVALUATION)


def fit_best_model(df: DataFrame, target: str, features: Sequence[str], date_col: str, tiebreak: Sequence[str], name: str, task: str = REGRESSION, **fit) -> tuple[Fitted, Split]:
    """Refit one model on the training part."""
    known = df.filter(F.col(target).isNotNull())
    split = chronological_split(known, date_col, tiebreak)
    train = known.filter(split.train)
    goal = target
    if task == CLASSIFICATION:
        train, goal = level_labels(train, target), "level"
    return fit_model(train, goal, features, name, task, **fit), split


def contiguous_folds(df: DataFrame, order: Sequence[str], folds: int, strata: Sequence[str] | None = None, by: str | None = None) -> Column:
    """Fold number for consecutive blocks of nearly equal size, inside each class when ``by`` is given."""

    def blocks(part: DataFrame) -> Column:
        n = part.count()
        size, extra = divmod(n, folds)
        ends = np.cumsum([size + (i < extra) for i in range(folds)])
        fold = None
        for i, inside in enumerate(cuts(part, order, [int(end) for end in ends[:-1]])):
            fold = F.when(inside, i) if fold is None else fold.when(inside, i)
        return fold.otherwise(folds - 1)

    if by is None:
        return blocks(df)
    out = None
    for value in strata or ():
        here = F.col(by) == F.lit(value)
        out = F.when(here, blocks(df.filter(here))) if out is None else out.when(here, blocks(df.filter(here)))
    return out


def _score(scored: DataFrame, target: str, task: str) -> float | None:
    if task == REGRESSION:
        return metrics.regression_metrics(scored, target, "prediction").first()["r2"]
    return metrics.classification_metrics(scored, target, "prediction").first()["f1"]


@dataclass(frozen=True)
class Trial:
    """Rows that a model learns from, its feature step, and the named rows that it is scored on."""

    rows: DataFrame
    step: FeatureStep
    checks: list[tuple[str, DataFrame]]


@dataclass(frozen=True)
class Trials:
    """The training part and its folds; any number of models and settings can share them."""

    goal: str
    folds: int
    parts: list[Trial]


@contextmanager
def trials(
    df: DataFrame, target: str, features: Sequence[str], date_col: str, tiebreak: Sequence[str], task: str = REGRESSION, folds: int = 5, scaler: str | None = "standard"
) -> Iterator[Trials]:
    """The chronological split and the validation folds of a table, kept until the block ends."""
    order = [date_col, *tiebreak]
    known = df.filter(F.col(target).isNotNull())
    split = chronological_split(known, date_col, tiebreak)
    train, test = known.filter(split.train), known.filter(~split.train)
    goal, classes = target, None
    if task == CLASSIFICATION:
        train, test = tertile_labels(train, test, target)
        goal, classes = "level", rules.LEVELS
    folds = min(folds, split.train_rows)
    if folds >= 2:
        train = train.withColumn("_fold", contiguous_folds(train, order, folds, classes, goal if classes else None))
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        parts = [(train, [("train", train), ("test", test)])]
        for i in range(folds if folds >= 2 else 0):
            parts.append((train.filter(F.col("_fold") != i), [("cv", train.filter(F.col("_fold") == i))]))
        steps = side_by_side(df.sparkSession, [partial(fit_features, rows, features, scaler) for rows, _ in parts])
        yield Trials(goal, folds, [Trial(rows, step, checks) for (rows, checks), step in zip(parts, steps, strict=True)])
    finally:
        train.unpersist()


def diagnose_models(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    date_col: str,
    tiebreak: Sequence[str],
    task: str = REGRESSION,
    models: Sequence[str] | None = None,
    params: dict[str, dict] | None = None,
    folds: int = 5,
    key: str | None = None,
    scaler: str | None = "standard",
    seed: int = 0,
    shared: Trials | None = None,
) -> DataFrame:
    """Train and test score, validation spread, diagnosis, adjusted score and advice per model.

    ``shared`` reuses the ``trials`` of the same table, target, features and folds."""
    if shared is None:
        with trials(df, target, features, date_col, tiebreak, task, folds, scaler) as made:
            return diagnose_models(df, target, features, date_col, tiebreak, task, models, params, folds, key, scaler, seed, made)
    chosen = list(models or model_names(task))

    def tried(part: Trial, name: str) -> tuple[dict[str, float | None], bool]:
        got: dict[str, float | None] = {}
        try:
            model = fit_model(part.rows, shared.goal, features, name, task, params=(params or {}).get(name), key=key, step=part.step, seed=seed)
            for kind, check in part.checks:
                got[kind] = _score(model.predict(check), shared.goal, task)
        except FIT_ERRORS:
            return got, True
        return got, False

    asked = [(part, name) for name in chosen for part in shared.parts]
    scores: dict[str, dict[str, list]] = {name: {"train": [], "test": [], "cv": []} for name in chosen}
    for (_, name), (got, failed) in zip(asked, side_by_side(df.sparkSession, [partial(tried, *one) for one in asked]), strict=True):
        for kind, value in got.items():
            scores[name][kind].append(value)
        if failed:
            scores[name]["failed"] = [True]
    rows = []
    for name, got in scores.items():
        if got.get("failed") and not got["test"]:
            rows.append((name, None, None, None, None))
            continue
        cv = got["cv"] if len(got["cv"]) == shared.folds else []
        mean, spread = (float(np.mean(cv)), float(np.std(cv))) if cv else (None, None)
        rows.append((name, got["train"][0], got["test"][0], mean, spread))
    table = df.sparkSession.createDataFrame(rows, "model string, train_score double, test_score double, cv_mean double, cv_std double")
    found = metrics.diagnose_scores(table)
    told = F.create_map(*[x for name, *_ in rows for d in rules.DIAGNOSES for x in (F.lit(f"{name}|{d}"), F.lit(advice(name, d)))])
    return found.withColumn("advice", told[F.concat_ws("|", "model", "diagnosis")])


def tune(df: DataFrame, target: str, features: Sequence[str], date_col: str, tiebreak: Sequence[str], name: str, task: str = REGRESSION, presets: dict[str, dict] | None = None, **fit) -> DataFrame:
    """Scores of one model under each tuning preset."""
    grid = presets or rules.PRESETS.get(name, {"Balanced": {}})
    scored = [partial(diagnose_models, df, target, features, date_col, tiebreak, task, [name], {name: params}, **fit) for params in grid.values()]
    parts = [found.withColumn("preset", F.lit(goal)) for goal, found in zip(grid, side_by_side(df.sparkSession, scored), strict=True)]
    return reduce(DataFrame.unionByName, parts)


def permutation_importance(model: Fitted, df: DataFrame, target: str, key: str, seed: int = 0) -> DataFrame:
    """Loss of score when one feature is replaced by that of a shuffled copy of the rows.

    The copy is ordered by a hash of the key and joined by position, once for all features.
    """
    rows = df.filter(F.col(target).isNotNull()).select(key, target, *model.features)
    straight, _ = with_ordinal(rows, [key], "_pos")
    mixed, _ = with_ordinal(rows.select(*[F.col(f).alias(f"_s_{f}") for f in model.features], F.xxhash64(F.col(key), F.lit(seed)).alias("_h"), key), ["_h", key], "_pos")
    both = straight.join(mixed.drop("_h", key), "_pos").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        base = _score(model.predict(rows), target, model.task)
        drops = []
        for f in model.features:
            swapped = both.withColumn(f, F.col(f"_s_{f}"))
            drops.append(max(0.0, base - _score(model.predict(swapped), target, model.task)))
    finally:
        both.unpersist()
    total = sum(drops)
    made = [(f, float(v), "Permutation importance", v / total * 100 if total else 0.0) for f, v in zip(model.features, drops, strict=True)]
    return df.sparkSession.createDataFrame(made, "feature string, importance double, method string, share double")


def experiment_rows(evaluation: DataFrame, target: str, features: int, run: str | None = None) -> DataFrame:
    """One history row per evaluated model, numbered by model name within the run.

    ``run_id`` and ``logged_at`` keep the runs of a history table apart."""
    run = run or uuid.uuid4().hex[:12]
    names = evaluation.select("model").distinct()
    numbered, _ = with_ordinal(names, ["model"], "_n")
    label = F.format_string("EXP-%03d", F.col("_n") + 1)
    return evaluation.join(numbered, "model").select(
        label.alias("experiment"), F.lit(target).alias("target"), "*", F.lit(features).cast("long").alias("feature_count"),
        F.lit(run).alias("run_id"), F.lit(datetime.datetime.now(datetime.timezone.utc)).alias("logged_at"),
    ).drop("_n")


def registry_row(evaluation: DataFrame, target: str, metric: str) -> DataFrame:
    """The champion candidate."""
    best = metrics.best_by(evaluation, metric)
    return best.select(
        F.lit("Champion Candidate").alias("role"), "model", F.lit(target).alias("target"), F.lit(metric).alias("metric"),
        F.col(metric).alias("value"), F.lit("Ready for review").alias("status"),
    )
