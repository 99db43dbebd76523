"""Named queries over a folder of Parquet tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round every double so that both engines print the same digits (and no negative zero)."""
    return df.select(
        *[
            (F.round(c, digits) + 0.0).alias(c) if t == "double" and c not in skip else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


def day(name: str):
    """Timestamp as YYYY-MM-DD text."""
    return F.date_format(F.col(name), "yyyy-MM-dd")
