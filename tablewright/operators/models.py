"""Supervised models on tables: one preparation step, one estimator, one fitted object.

Medians, means and spreads are exact one-row statistics that become literals of an SQL
stage, so a fitted model is an ordinary ``PipelineModel`` that can be saved.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IndexToString, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tablewright.functions import rules
from tablewright.functions.columns import FEW_ROWS, finite, is_float, one_row, sort_key, spread_rows
from tablewright.operators import boosting, class_forest, kernel, network, pruning, trees
from tablewright.operators.neighbors import knn_predict
from tablewright.operators.ordinal import running, windowed
from tablewright.operators.quantiles import quantile_values

REGRESSION, CLASSIFICATION = "Regression", "Classification"
REGRESSORS = [
    "Ridge", "ElasticNet", "BayesianRidge", "RandomForest", "ExtraTrees", "LinearRegression", "SVR",
    "GradientBoosting", "HistGradientBoosting", "DecisionTree", "KNNRegressor", "NeuralNetwork",
]
CLASSIFIERS = ["RandomForest", "LogisticRegression", "DecisionTree", "KNNClassifier", "NeuralNetwork"]
MAX_DEPTH = 30  # Spark's bound for "no limit"
MAX_CLASSES = 100
#: Histograms that a tree learner sums at once; more nodes in a pass mean fewer passes over the rows.
TREE_MEMORY_MB = 1_024
#: Bins of a feature in a decision tree; exact where a feature has no more values.
TREE_BINS = 255
FAMILY = {
    "RandomForest": "tree", "ExtraTrees": "tree", "DecisionTree": "tree", "GradientBoosting": "boosting",
    "HistGradientBoosting": "boosting", "KNNRegressor": "neighbors", "KNNClassifier": "neighbors", "NeuralNetwork": "network",
    "SVR": "kernel", "Ridge": "linear", "ElasticNet": "linear", "BayesianRidge": "linear", "LinearRegression": "linear",
    "LogisticRegression": "linear",
}

# Default strength of every model.
DEFAULTS: dict[tuple[str, str], dict] = {
    (REGRESSION, "Ridge"): {"alpha": 1.0},
    (REGRESSION, "ElasticNet"): {"alpha": 0.05, "l1_ratio": 0.2, "max_iter": 5000},
    (REGRESSION, "RandomForest"): {"n_estimators": 500, "max_depth": None, "min_samples_leaf": 2, "min_samples_split": 4, "max_features": "sqrt"},
    (REGRESSION, "ExtraTrees"): {"n_estimators": 500, "max_depth": None, "min_samples_leaf": 2, "min_samples_split": 4, "max_features": "sqrt"},
    (REGRESSION, "SVR"): {"C": 1.0, "epsilon": 0.1, "gamma": "scale", "width": 100},
    (REGRESSION, "GradientBoosting"): {"n_estimators": 300, "learning_rate": 0.03, "max_depth": 3, "min_samples_leaf": 3, "subsample": 0.8},
    (REGRESSION, "HistGradientBoosting"): {"max_iter": 350, "learning_rate": 0.03, "max_leaf_nodes": 15, "l2_regularization": 0.05, "min_samples_leaf": 20, "max_depth": None},
    (REGRESSION, "DecisionTree"): {"max_depth": 5, "min_samples_leaf": 8, "min_samples_split": 16, "ccp_alpha": 0.005},
    (REGRESSION, "KNNRegressor"): {"n_neighbors": 5, "weights": "uniform"},
    (CLASSIFICATION, "RandomForest"): {"n_estimators": 300, "max_depth": 8, "min_samples_leaf": 5},
    (CLASSIFICATION, "LogisticRegression"): {"C": 0.5, "max_iter": 1000},
    (CLASSIFICATION, "DecisionTree"): {"max_depth": 5, "min_samples_leaf": 8, "min_samples_split": 16, "ccp_alpha": 0.005},
    (CLASSIFICATION, "KNNClassifier"): {"n_neighbors": 9, "weights": "uniform"},
    (REGRESSION, "NeuralNetwork"): {"hidden_layers": 1, "hidden_units": 32, "alpha": 0.01, "learning_rate_init": 0.001, "max_iter": 800},
    (CLASSIFICATION, "NeuralNetwork"): {"hidden_layers": 1, "hidden_units": 32, "alpha": 0.01, "learning_rate_init": 0.001, "max_iter": 800},
}


def model_names(task: str) -> list[str]:
    return list(REGRESSORS if task == REGRESSION else CLASSIFIERS)


def settings(name: str, task: str, params: dict | None = None) -> dict:
    if name not in model_names(task):
        raise ValueError(f"{name} is no {task.lower()} model")
    return {**DEFAULTS.get((task, name), {}), **(params or {})}


@dataclass
class FeatureStep:
    """Median fill and optional scaling as literals: value -> (filled - shift) / scale."""

    features: list[str]
    fill: list[float]
    shift: list[float]
    scale: list[float]

    def columns(self) -> list[Column]:
        made = []
        for f, fill, shift, scale in zip(self.features, self.fill, self.shift, self.scale, strict=True):
            made.append((F.coalesce(F.col(f).cast("double"), F.lit(fill)) - F.lit(shift)) / F.lit(scale))
        return made

    def sql(self) -> str:
        parts = [
            f"(coalesce(cast(`{f}` AS double), double('{fill!r}')) - double('{shift!r}')) / double('{scale!r}') AS `_x{i}`"
            for i, (f, fill, shift, scale) in enumerate(zip(self.features, self.fill, self.shift, self.scale, strict=True))
        ]
        return f"SELECT *, {', '.join(parts)} FROM __THIS__"

    @property
    def names(self) -> list[str]:
        return [f"_x{i}" for i in range(len(self.features))]


def fit_features(df: DataFrame, features: Sequence[str], scaler: str | None = "standard", **how) -> FeatureStep:
    """Medians and, for "standard" or "minmax", the location and width after filling.

    The standard width is the population deviation; a constant feature keeps width 1.
    """
    features = list(features)
    middle = quantile_values(df, features, [0.5], **how)
    fill = [float(middle[f][0]) if middle[f][0] is not None else 0.0 for f in features]
    shift, scale = [0.0] * len(features), [1.0] * len(features)
    if scaler:
        filled = [F.coalesce(F.col(f).cast("double"), F.lit(v)) for f, v in zip(features, fill, strict=True)]
        row = one_row(
            df.select(*[c.alias(f"x{i}") for i, c in enumerate(filled)]),
            *[f(f"x{i}").alias(f"{n}{i}") for i in range(len(features)) for n, f in (("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max))],
        )
        for i in range(len(features)):
            if row[f"m{i}"] is None:
                continue
            flat = row[f"lo{i}"] == row[f"hi{i}"]
            if scaler == "standard":
                shift[i], scale[i] = row[f"m{i}"], 1.0 if flat else row[f"s{i}"]
            else:
                shift[i], scale[i] = row[f"lo{i}"], 1.0 if flat else row[f"hi{i}"] - row[f"lo{i}"]
    return FeatureStep(features, fill, shift, scale)


@dataclass
class Fitted:
    """A trained model: ``predict`` adds a prediction column to any table with the features."""

    name: str
    task: str
    step: FeatureStep
    pipeline: PipelineModel | None = None
    classes: list[str] = field(default_factory=list)
    neighbors: dict | None = None
    kernel: kernel.Kernel | None = None
    forest: dict | None = None
    network: network.Network | None = None
    saved: list[float] | None = None

    @property
    def features(self) -> list[str]:
        return self.step.features

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise ValueError(f"columns missing for scoring: {', '.join(missing)}")
        if self.neighbors is not None:
            asked = df.withColumns(dict(zip(self.step.names, self.step.columns(), strict=True)))
            return knn_predict(asked, features=self.step.names, name=name, **self.neighbors).drop(*self.step.names)
        if self.forest is not None:
            asked = df.withColumns(dict(zip(self.step.names, self.step.columns(), strict=True)))
            sums = trees.forest_sums(asked, self.forest["parts"], self.step.names)
            mean = (F.col("s.total") / F.lit(self.forest["trees"]) + F.lit(self.forest["middle"])).alias(name)
            if sums.limit(trees.PART_POINTS + 1).count() <= trees.PART_POINTS:
                sums = F.broadcast(sums)  # the rows stay where they are
            same = [F.col(f"q.{x}") + 0.0 == F.col(f"s.{x}") for x in self.step.names]
            return asked.alias("q").join(sums.alias("s"), reduce(and_, same), "left").select(*[F.col(f"q.`{c}`") for c in df.columns], mean)
        if self.kernel is not None:
            return df.withColumn(name, self.kernel.column(self.step.columns()))
        if self.network is not None:
            return self._network_scores(df, name)
        made = self.pipeline.transform(spread_rows(df) if self.name == "RandomForest" else df)
        keep = [F.col(f"`{c}`") for c in df.columns]
        if self.task == REGRESSION:
            return made.select(*keep, F.col("prediction").alias(name))
        chance = F.col("probability") if isinstance(made.schema["probability"].dataType, ArrayType) else vector_to_array("probability")
        scores = [chance[i].alias(f"score_{c}") for i, c in enumerate(self.classes)]
        return made.select(*keep, F.col("predicted_label").alias(name), F.array_max(chance).alias("confidence"), *scores)

    def _network_scores(self, df: DataFrame, name: str) -> DataFrame:
        made = df.withColumn("_out", self.network.outputs(self.step.columns()))
        keep, out = [F.col(f"`{c}`") for c in df.columns], F.col("_out")
        if self.task == REGRESSION:
            return made.select(*keep, out[0].alias(name))
        best = F.element_at(F.array(*[F.lit(c) for c in self.classes]), F.array_position(out, F.array_max(out)).cast("int"))
        scores = [out[i].alias(f"score_{c}") for i, c in enumerate(self.classes)]
        return made.select(*keep, best.alias(name), F.array_max(out).alias("confidence"), *scores)

    def importance(self) -> DataFrame:
        """Share of every feature: tree importances or absolute coefficients."""
        if self.saved is not None:
            return self._shares(self.saved, "Built-in feature importance")
        if self.forest is not None:
            return self._shares(trees.importance(self.forest["parts"], self.step.names), "Built-in feature importance")
        last = next((s for s in reversed(self.pipeline.stages) if hasattr(s, "featureImportances") or hasattr(s, "coefficients") or hasattr(s, "coefficientMatrix")), None) if self.pipeline else None
        if last is None:
            raise ValueError(f"{self.name} has no built-in importance, use permutation_importance")
        if hasattr(last, "featureImportances"):
            values, method = last.featureImportances.toArray(), "Built-in feature importance"
        elif self.task == CLASSIFICATION:
            values, method = np.abs(last.coefficientMatrix.toArray()).mean(axis=0), "Absolute coefficient size"
        else:
            values, method = np.abs(last.coefficients.toArray()), "Absolute coefficient size"
        return self._shares(values, method)

    def _shares(self, values: Sequence[float], method: str) -> DataFrame:
        total = float(sum(values))
        rows = [(f, float(v), method, float(v) / total * 100 if total else 0.0) for f, v in zip(self.features, values, strict=True)]
        return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double, method string, share double")


def _trees(name: str, task: str, p: dict, seed: int):
    depth = MAX_DEPTH if p.get("max_depth") is None else min(MAX_DEPTH, int(p["max_depth"]))
    base = {"featuresCol": "features", "labelCol": "_label", "seed": seed}
    if name == "RandomForest":
        return RandomForestClassifier(
            **base, numTrees=int(p["n_estimators"]), maxDepth=depth, minInstancesPerNode=int(p["min_samples_leaf"]),
            featureSubsetStrategy=p.get("max_features") or "sqrt", maxMemoryInMB=TREE_MEMORY_MB,
        )
    kind = DecisionTreeRegressor if task == REGRESSION else DecisionTreeClassifier
    return kind(**base, maxDepth=depth, minInstancesPerNode=int(p["min_samples_leaf"]), maxBins=TREE_BINS, maxMemoryInMB=TREE_MEMORY_MB, weightCol="_weight")


def _pruned(prepare: list, rows: DataFrame, name: str, task: str, p: dict, seed: int, classes: int = 0) -> tuple[list, list[float]]:
    """Stages of a decision tree that is grown, then pruned, on the same rows."""
    ready = PipelineModel(prepare).transform(rows.filter("_weight > 0")).select("features", "_label", "_weight").persist()
    try:
        grown = _trees(name, task, p, seed).fit(ready)
        return pruning.pruned_stages(grown, ready, float(p["ccp_alpha"]), int(p["min_samples_split"]), classes)
    finally:
        ready.unpersist()


def _network(rows: DataFrame, step: FeatureStep, p: dict, outputs: int, classes: bool, seed: int) -> network.Network:
    """A network whose sizes and rates follow the settings."""
    sizes = (len(step.features), *[int(p["hidden_units"])] * int(p["hidden_layers"]), outputs)
    rule = network.Training(sizes, classes, float(p["alpha"]), float(p["learning_rate_init"]), int(p["max_iter"]), seed)
    ready = rows.select(*[c.alias(n) for n, c in zip(step.names, step.columns(), strict=True)], "_label", "_weight")
    return network.fit_network(ready, step.names, rule)


def _weighted_spread(rows: DataFrame) -> tuple[float, float]:
    """Summed weight and weighted deviation of the label; the second pass avoids cancellation."""
    weight, label = F.col("_weight"), F.col("_label")
    facts = one_row(rows, F.sum(weight).alias("n"), F.sum(weight * label).alias("s"))
    if not facts["n"]:
        return 0.0, 0.0
    apart = label - F.lit(facts["s"] / facts["n"])
    around = one_row(rows, F.sum(weight * apart * apart).alias("v"))["v"]
    return facts["n"], math.sqrt(around / facts["n"])


def _ridge_strength(rows: DataFrame, alpha: float) -> float:
    """Spark's penalty for a given alpha: it divides by the row weight and the label's weighted deviation."""
    total, spread = _weighted_spread(rows)
    return alpha * spread / total if total else 0.0


def _linear(name: str, p: dict, rows: DataFrame) -> LinearRegression:
    base = {"featuresCol": "features", "labelCol": "_label", "weightCol": "_weight"}
    if name == "ElasticNet":
        # The normal equations are summed in one pass; the L1 steps then run on the d x d matrix.
        spread = _weighted_spread(rows)[1]
        alpha, l1 = float(p["alpha"]), float(p["l1_ratio"])
        strength = alpha * l1 + alpha * spread * (1 - l1)
        return LinearRegression(
            **base, regParam=strength, elasticNetParam=alpha * l1 / strength if strength else 0.0, standardization=False,
            maxIter=int(p["max_iter"]), solver="normal", tol=1e-9,
        )
    if name == "Ridge":
        return LinearRegression(**base, regParam=_ridge_strength(rows, float(p["alpha"])), elasticNetParam=0.0, standardization=False, solver="normal")
    return LinearRegression(**base, regParam=0.0, solver="normal")


def _evidence(rows: DataFrame, names: Sequence[str], rounds: int = 300, tol: float = 1e-3) -> tuple[np.ndarray, float]:
    """Bayesian ridge: evidence iterations on the d x d matrix of weighted moments."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    weight, every = F.col("_weight"), [*names, "_label"]
    means = one_row(rows, F.sum(weight).alias("n"), *[(F.sum(weight * F.col(c)) / F.sum(weight)).alias(f"m_{c}") for c in every])
    apart = {c: F.col(c) - F.lit(means[f"m_{c}"]) for c in every}

    def moment(a: str, b: str) -> Column:
        return F.sum(weight * apart[a] * apart[b]) / F.sum(weight)

    spread = one_row(
        rows, *[moment(a, b).alias(f"c_{a}_{b}") for a, b in pairs], *[moment(a, "_label").alias(f"c_{a}_y") for a in names],
        moment("_label", "_label").alias("v"),
    )
    row = {**means.asDict(), **spread.asDict()}
    n, d = row["n"], len(names)
    gram, right = np.zeros((d, d)), np.array([row[f"c_{a}_y"] for a in names]) * n
    for i, a in enumerate(names):
        for j in range(i, d):
            gram[i, j] = gram[j, i] = row[f"c_{a}_{names[j]}"] * n
    values, vectors = np.linalg.eigh(gram)
    values = np.clip(values, 0, None)
    noise, prior = 1.0 / (row["v"] + np.finfo(float).eps), 1.0
    weights = np.zeros(d)
    for _ in range(rounds):
        new = vectors @ ((vectors.T @ right) / (values + prior / noise))
        rest = row["v"] * n - 2 * new @ right + new @ gram @ new
        used = (noise * values / (prior + noise * values)).sum()
        prior = (used + 2e-6) / (new @ new + 2e-6)
        noise = (n - used + 2e-6) / (rest + 2e-6)
        done, weights = np.abs(weights - new).sum() < tol, new
        if done:
            break
    return weights, float(row["m__label"] - weights @ np.array([row[f"m_{a}"] for a in names]))


def _forest(name: str, ready: DataFrame, names: Sequence[str], p: dict, seed: int) -> dict:
    """Trees over points: their parts, how many of them make a mean, and where they start."""
    weight, leaf = F.col("_weight"), int(p["min_samples_leaf"])
    if FAMILY[name] == "boosting":
        rounds, depth = int(p.get("max_iter") or p["n_estimators"]), p["max_depth"]
        most = int(p.get("max_leaf_nodes") or 2 ** (MAX_DEPTH if depth is None else depth))
        rule = boosting.Boosting(rounds, float(p["learning_rate"]), most, leaf, float(p.get("l2_regularization", 0.0)), depth, float(p.get("subsample", 1.0)), seed)
        parts, middle = boosting.fit_boosting(ready, names, "_label", weight, rule)
        return {"parts": parts, "trees": 1, "middle": middle}
    count, best = int(p["n_estimators"]), name == "RandomForest"
    rule = trees.Growth(p["max_depth"], int(p["min_samples_split"]), leaf, trees.features_drawn(p["max_features"], len(names)), seed, best)
    if best and trees.few_points(ready, names):
        blocks, middle = trees.drawn_blocks(ready, names, "_label", weight, count, seed)
        return {"parts": trees.fit_drawn(blocks, len(names), rule), "trees": count, "middle": middle}
    points, middle = trees.drawn_points(ready, names, "_label", weight, count, seed) if best else trees.points_of(ready, names, "_label", weight)
    return {"parts": trees.fit_forest(points, names, count, rule), "trees": count, "middle": middle}


def classes_of(df: DataFrame, target: str) -> list[str]:
    found = df.filter(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("c")).distinct().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{target} has more than {MAX_CLASSES} classes")
    return sorted(r["c"] for r in found)


def fit_model(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    name: str,
    task: str = REGRESSION,
    scaler: str | None = "standard",
    params: dict | None = None,
    weight: str | None = None,
    key: str | None = None,
    seed: int = 0,
    step: FeatureStep | None = None,
    **how,
) -> Fitted:
    """Train one model.  ``key`` is a unique column that breaks ties between neighbours;
    ``step`` reuses the medians and scales of the same rows for another model."""
    p = settings(name, task, params)
    known = df.filter(F.col(target).isNotNull())
    step = step or fit_features(known, features, scaler, **how)
    if name.startswith("KNN"):
        points = known.select(*[c.alias(n) for n, c in zip(step.names, step.columns(), strict=True)], target, key)
        facts = {"points": points, "target": target, "key": key, "k": int(p["n_neighbors"]), "weights": p["weights"], "task": task}
        return Fitted(name, task, step, neighbors=facts)
    prepare = [SQLTransformer(statement=step.sql()), VectorAssembler(inputCols=step.names, outputCol="features")]
    heavy = F.col(weight).cast("double") if weight else F.lit(1.0)
    if task == CLASSIFICATION:
        classes = classes_of(known, target)
        code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(target).cast("string")) - 1
        rows = known.select(*features, code.cast("double").alias("_label"), heavy.alias("_weight"))
        if name == "LogisticRegression":
            n = rows.count()
            last = LogisticRegression(featuresCol="features", labelCol="_label", weightCol="_weight", regParam=1 / (float(p["C"]) * n), standardization=False, family="multinomial", maxIter=int(p["max_iter"]))
        elif name == "NeuralNetwork":
            return Fitted(name, task, step, classes=classes, network=_network(rows, step, p, max(1, len(classes)), True, seed))
        else:
            last = _trees(name, task, p, seed)
        names = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=classes)
        if name == "DecisionTree":
            stages, saved = _pruned(prepare, rows, name, task, p, seed, len(classes))
            return Fitted(name, task, step, PipelineModel([*prepare, *stages, names]), classes, saved=saved)
        if name == "RandomForest" and len(classes) > 1 and rows.limit(FEW_ROWS + 1).count() > FEW_ROWS:
            points = rows.filter("_label IS NOT NULL").select(*[c.alias(n) for n, c in zip(step.names, step.columns(), strict=True)], "_label")
            forest = class_forest.fit_class_forest(points, step.names, last, len(classes))
            if forest is not None:
                return Fitted(name, task, step, PipelineModel([*prepare, forest, names]), classes)
        ready = PipelineModel(prepare).transform(spread_rows(rows) if name == "RandomForest" else rows)
        pipeline = PipelineModel([*prepare, Pipeline(stages=[last]).fit(ready).stages[0], names])
        return Fitted(name, task, step, pipeline, classes)
    rows = known.select(*features, F.col(target).cast("double").alias("_label"), heavy.alias("_weight"))
    if name == "BayesianRidge":
        weights, intercept = _evidence(SQLTransformer(statement=step.sql()).transform(rows), step.names)
        line = " + ".join([f"double('{intercept!r}')", *[f"double('{float(w)!r}') * `{x}`" for w, x in zip(weights, step.names, strict=True)]])
        last = SQLTransformer(statement=f"SELECT *, {line} AS prediction FROM __THIS__")
        return Fitted(name, task, step, PipelineModel([prepare[0], last]))
    if name == "SVR":
        ready = spread_rows(rows.select(*[c.alias(n) for n, c in zip(step.names, step.columns(), strict=True)], "_label", "_weight")).persist()
        try:
            made = kernel.fit_svr(ready, step.names, float(p["C"]), float(p["epsilon"]), p["gamma"], int(p["width"]), seed)
        finally:
            ready.unpersist()
        return Fitted(name, task, step, kernel=made)
    if name == "NeuralNetwork":
        return Fitted(name, task, step, network=_network(rows, step, p, 1, False, seed))
    if name == "DecisionTree":
        stages, saved = _pruned(prepare, rows, name, task, p, seed)
        return Fitted(name, task, step, PipelineModel([*prepare, *stages]), saved=saved)
    if FAMILY[name] in ("tree", "boosting"):
        ready = rows.select(*[c.alias(n) for n, c in zip(step.names, step.columns(), strict=True)], "_label", "_weight")
        return Fitted(name, task, step, forest=_forest(name, ready, step.names, p, seed))
    last = _linear(name, p, rows)
    return Fitted(name, task, step, PipelineModel([*prepare, last.fit(PipelineModel(prepare).transform(rows))]))


@dataclass
class ChangeModel:
    """A model of the step from row to row; the level is the running sum of its clipped steps."""

    model: Fitted
    low: float
    high: float

    def predict(self, test: DataFrame, last: DataFrame | float, order: Sequence[str], keys: Sequence[str] = (), grain: str | None = None, name: str = "prediction") -> DataFrame:
        """``last`` is the last known level: one number, or a (keys..., last_value) table."""
        steps = self.model.predict(test, "_raw").withColumn("_step", F.least(F.greatest(F.col("_raw"), F.lit(self.low)), F.lit(self.high)))
        summed = running(steps, keys, order, sums={"_sum": "_step"}, grain=grain)
        if keys:
            levels = summed.join(last, list(keys))
            return levels.withColumn(name, F.col("last_value") + F.col("_sum")).drop("_raw", "_step", "_sum", "last_value")
        return summed.withColumn(name, F.lit(float(last)) + F.col("_sum")).drop("_raw", "_step", "_sum")


@dataclass(frozen=True)
class Steps:
    """Rows with their change to the previous row, and the bounds a predicted step keeps."""

    rows: DataFrame
    low: float
    high: float


STEP = "_change"


def change_steps(train: DataFrame, target: str, order: Sequence[str], keys: Sequence[str] = (), grain: str | None = None) -> Steps:
    """First differences; steps are bounded by their 1 % and 99 % quantiles, and by 0 when the level never fell."""
    build = lambda w: [{STEP: F.col(target) - F.lag(target, 1).over(w)}]
    rows = windowed(train, keys, order, build, back=1, grain=grain).filter(F.col(STEP).isNotNull()).persist()
    low, high = quantile_values(rows, [STEP], [0.01, 0.99])[STEP]
    fell = one_row(rows, (F.min(STEP) < 0).alias("f"))["f"]
    return Steps(rows, low if fell else 0.0, high)


def fit_change_model(steps: Steps, features: Sequence[str], name: str, **fit) -> ChangeModel:
    """Train on the differences; many models can share one ``steps``."""
    return ChangeModel(fit_model(steps.rows, STEP, features, name, REGRESSION, **fit), steps.low, steps.high)


def last_level(train: DataFrame, target: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame | float:
    known = train.filter(F.col(target).isNotNull())
    last = F.max_by(F.col(target).cast("double"), sort_key(list(order))).alias("last_value")
    return known.groupBy(*keys).agg(last) if keys else one_row(known, last)["last_value"]


def score_defaults(df: DataFrame, features: Sequence[str], **how) -> DataFrame:
    """One row of medians (0 where a column is empty) as a starting point for scoring."""
    middle = quantile_values(df, list(features), [0.5], **how)
    row = [float(middle[f][0]) if middle[f][0] is not None else 0.0 for f in features]
    return df.sparkSession.createDataFrame([tuple(row)], ", ".join(f"`{f}` double" for f in features))


def what_if(
    df: DataFrame,
    fitted: Fitted,
    scenarios: Sequence[tuple[str, dict[str, float]]],
    order: Sequence[str],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Baseline and scenario predictions for the latest complete row of every series.

    A scenario adds its amounts to the named features; all scenarios are scored at once.
    """
    features = fitted.features
    complete = df.dropna("any", subset=[*features, *order])
    latest = complete.groupBy(*keys).agg(F.max_by(F.struct(*features), sort_key(list(order))).alias("_b"))
    cases = [("Baseline", {}), *scenarios]
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("scenario"), *[(F.col(f"_b.{f}").cast("double") + F.lit(float(change.get(f, 0.0)))).alias(f) for f in features])
            for n, change in cases
        ]
    )
    table = latest.select(*keys, F.explode(rows).alias("s")).select(*keys, "s.*")
    scored = fitted.predict(table, "predicted")
    base = scored.filter(F.col("scenario") == "Baseline").select(*keys, F.col("predicted").alias("baseline"))
    if keys:
        joined = scored.join(base, list(keys))
    else:
        joined = scored.withColumn("baseline", base.select("baseline").scalar())
    return joined.withColumn("delta", F.col("predicted") - F.col("baseline"))


def advice(name: str, diagnosis: str) -> str:
    by_family = rules.ADVICE.get(diagnosis, {})
    return by_family.get(FAMILY.get(name, ""), by_family.get("any", "check the settings"))


def clean_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Infinite feature values become NULL (and are then filled by the median)."""
    return df.withColumns({f: finite(f) for f in features if is_float(df, f)}) if features else df
