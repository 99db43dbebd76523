"""Writing tables: CSV, partitioned Parquet, report marts, models and run logs."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.sources.tables import layer_path, path_exists

REQUIRED = ("target", "task", "model", "features")


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_by_month(df: DataFrame, date_col: str, path: str) -> str:
    """Parquet partitioned by year and month.

    The rebalance hint lets Spark split a month that holds most of the table over many
    tasks and merge small ones.
    """
    parts = df.withColumn("year", F.year(date_col)).withColumn("month", F.month(date_col))
    balanced = parts.hint("rebalance", F.col("year"), F.col("month"))
    balanced.write.mode("overwrite").partitionBy("year", "month").parquet(path)
    return path


def read_months(spark: SparkSession, path: str, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """Only the partitions between two (year, month) pairs are listed and read."""
    at = F.col("year") * 12 + F.col("month")
    table = spark.read.parquet(path)
    inside = F.col("year").between(first[0], last[0]) & at.between(first[0] * 12 + first[1], last[0] * 12 + last[1])
    return table.filter(inside)


def publish_mart(df: DataFrame, root: str, name: str, partition: str | None = None) -> str:
    """Write an aggregated table to the reporting layer for serving."""
    path = layer_path(root, "08_reporting", name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return path


def save_model(spark: SparkSession, pipeline: PipelineModel, path: str, **facts) -> str:
    """A fitted pipeline next to one metadata row."""
    missing = [k for k in REQUIRED if k not in facts]
    if missing:
        raise ValueError(f"model metadata is missing: {', '.join(missing)}")
    pipeline.write().overwrite().save(f"{path}/pipeline")
    row = [(json.dumps({"kind": "model", "version": 1, **facts}, default=str),)]
    spark.createDataFrame(row, "facts string").write.mode("overwrite").parquet(f"{path}/facts")
    return path


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """Load a model and check that it is whole."""
    for part in ("facts", "pipeline"):
        if not path_exists(spark, f"{path}/{part}"):
            raise ValueError(f"not a model folder, {part} is missing: {path}")
    facts = json.loads(spark.read.parquet(f"{path}/facts").first()["facts"])
    missing = [k for k in REQUIRED if k not in facts]
    if facts.get("kind") != "model" or missing:
        raise ValueError(f"model folder is incomplete: {', '.join(missing) or 'wrong kind'}")
    return PipelineModel.load(f"{path}/pipeline"), facts


def append_log(df: DataFrame, path: str) -> str:
    """Append run rows to a history table."""
    df.write.mode("append").parquet(path)
    return path
