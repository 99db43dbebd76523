"""Fitted models of every kind as folders: one row of facts, and next to it what the kind needs."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import kernel, neighbors, network, trees
from tablewright.operators.models import FeatureStep, Fitted
from tablewright.sources.tables import path_exists

STEP_PARTS = ("features", "fill", "shift", "scale")


def kind_of(fitted: Fitted) -> str:
    return next(kind for kind in ("neighbors", "forest", "kernel", "network", "pipeline") if getattr(fitted, kind) is not None)


def save_fitted(spark: SparkSession, fitted: Fitted, path: str, **facts) -> str:
    """Write a fitted model; ``facts`` (target, dates, scores) come back with it.

    Pipelines are saved as such, forests as their table of parts, neighbours as a layout partitioned by box; kernels and
    networks are a few arrays among the facts.
    """
    kind = kind_of(fitted)
    held: dict = {}
    if kind == "pipeline":
        fitted.pipeline.write().overwrite().save(f"{path}/pipeline")
    elif kind == "forest":
        fitted.forest["parts"].write.mode("overwrite").parquet(f"{path}/parts")
        held = {k: v for k, v in fitted.forest.items() if k != "parts"}
    elif kind == "neighbors":
        held = {k: fitted.neighbors[k] for k in ("k", "weights", "task")}
        neighbors.store(_laid_out(fitted), f"{path}/layout")
    elif kind == "kernel":
        made = fitted.kernel
        held = {"directions": made.directions.tolist(), "phase": made.phase.tolist(), "weights": made.weights.tolist(), "intercept": made.intercept}
    else:
        made, rule = fitted.network, fitted.network.rule
        held = {"theta": made.theta.tolist(), "middle": made.middle, "spread": made.spread, "rounds": made.rounds, "rule": vars(rule)}
    whole = {
        "name": fitted.name, "task": fitted.task, "classes": fitted.classes, "saved": fitted.saved, "kind": kind, "held": held,
        "step": {part: getattr(fitted.step, part) for part in STEP_PARTS}, "facts": facts,
    }
    spark.createDataFrame([(json.dumps(whole, default=str),)], "facts string").write.mode("overwrite").parquet(f"{path}/model")
    return path


def _laid_out(fitted: Fitted) -> neighbors.Layout:
    known = fitted.neighbors
    if known.get("index") is not None:
        return known["index"]
    points = known["points"].filter(F.col(known["target"]).isNotNull())
    return neighbors.lay_out(points, fitted.step.names, known["k"], known["key"], known["target"])


def load_fitted(spark: SparkSession, path: str) -> tuple[Fitted, dict]:
    """The model and the facts that were saved with it; a folder that is not whole raises."""
    if not path_exists(spark, f"{path}/model"):
        raise ValueError(f"not a model folder: {path}")
    whole = json.loads(spark.read.parquet(f"{path}/model").first()["facts"])
    kind, held = whole["kind"], whole["held"]
    needed = {"pipeline": "pipeline", "forest": "parts", "neighbors": "layout"}.get(kind)
    if needed and not path_exists(spark, f"{path}/{needed}"):
        raise ValueError(f"model folder is incomplete, {needed} is missing: {path}")
    made = Fitted(whole["name"], whole["task"], FeatureStep(**whole["step"]), classes=whole["classes"], saved=whole["saved"])
    if kind == "pipeline":
        made.pipeline = PipelineModel.load(f"{path}/pipeline")
    elif kind == "forest":
        made.forest = {**held, "parts": trees.load_parts(spark, f"{path}/parts")}
    elif kind == "neighbors":
        made.neighbors = {**held, "index": neighbors.load(spark, f"{path}/layout")}
    elif kind == "kernel":
        made.kernel = kernel.Kernel(np.array(held["directions"]), np.array(held["phase"]), np.array(held["weights"]), held["intercept"])
    else:
        rule = network.Training(**{**held["rule"], "sizes": tuple(held["rule"]["sizes"])})
        made.network = network.Network(rule, np.array(held["theta"]), held["middle"], held["spread"], held["rounds"])
    return made, whole["facts"]


def same_scores(one: Fitted, other: Fitted, df: DataFrame, key: str) -> bool:
    """Whether two models predict the same for every row of a table with a unique key."""
    both = one.predict(df, "_one").select(key, "_one").join(other.predict(df, "_other").select(key, "_other"), key, "full")
    return both.filter(~F.col("_one").eqNullSafe(F.col("_other"))).isEmpty()
