"""Marts that grow: partial aggregates are stored for each partition, and only new or changed partitions are read again.

Partials can be merged: counts, sums, means with summed squares around them, minima, maxima and sketches of distinct values.
A mart is merged from its partials when it is read, so its cost follows keys and partitions, never the rows behind them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tablewright.session import work_dir
from tablewright.sources.tables import path_exists


@dataclass(frozen=True)
class Mart:
    """Where partials lie and what they hold.

    ``part`` is the column whose values are published one by one (a month, a day, a region); its number of values is the
    number of folders.  ``distinct`` columns are counted by sketches, all else is exact.
    """

    path: str
    part: str
    keys: list[str]
    measures: list[str]
    distinct: list[str] = field(default_factory=list)

    def partials(self, df: DataFrame) -> DataFrame:
        """One row for each partition and key."""
        made: list[Column] = [F.count("*").alias("n")]
        for m in self.measures:
            value = F.col(m).cast("double")
            made += [F.count(m).alias(f"{m}_n"), F.sum(value).alias(f"{m}_sum"), (F.var_pop(value) * F.count(m)).alias(f"{m}_apart")]
            made += [F.min(value).alias(f"{m}_min"), F.max(value).alias(f"{m}_max")]
        made += [F.hll_sketch_agg(F.col(c).cast("string")).alias(f"{c}_sketch") for c in self.distinct]
        return df.groupBy(*self.keys, self.part).agg(*made)

    def stored(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """The partials; the given schema keeps partition values in their own type."""
        if not path_exists(spark, self.path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(self.path)


def _is_one_of(part: str, values: Sequence) -> Column:
    known = [v for v in values if v is not None]
    found = F.col(part).isin(known) if known else F.lit(False)
    return (found | F.col(part).isNull()) if len(known) < len(values) else found


def due_partitions(df: DataFrame, mart: Mart) -> list:
    """Partition values whose rows are not those that were counted when they were published.

    Both counts read no column but the partition's own; one value per folder reaches the driver.  A partition whose rows all
    went away is not due: its folder stays until ``refresh`` is told so by ``gone``.
    """
    schema = mart.partials(df).schema
    offered = df.groupBy(mart.part).agg(F.count("*").alias("rows"))
    known = mart.stored(df.sparkSession, schema).groupBy(mart.part).agg(F.sum("n").alias("known"))
    same = F.col("o." + mart.part).eqNullSafe(F.col("k." + mart.part))
    joined = offered.alias("o").join(known.alias("k"), same, "left")
    return [r[0] for r in joined.filter(F.col("known").isNull() | (F.col("known") != F.col("rows"))).select(F.col("o." + mart.part)).collect()]


def refresh(df: DataFrame, mart: Mart, again: Sequence = (), gone: Sequence = ()) -> list:
    """Publish what is new: partials of the due partitions replace theirs, all other folders stay untouched.

    ``again`` names partitions whose rows changed without changing their number, ``gone`` those to be taken out (an empty row stays).  The values
    that were read are returned; they reach the scan as a filter on the partition column.
    """
    spark = df.sparkSession
    due = list(dict.fromkeys([*due_partitions(df, mart), *again]))
    if due:
        made = mart.partials(df.filter(_is_one_of(mart.part, due)))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(mart.part).parquet(mart.path)
    if gone and path_exists(spark, mart.path):
        work_dir(spark)
        schema = mart.partials(df).schema
        kept = mart.stored(spark, schema).filter(_is_one_of(mart.part, gone)).select(mart.part).distinct()
        empty = {f.name: F.lit(0) if f.name == "n" else F.lit(None) for f in schema if f.name != mart.part}
        emptied = kept.withColumns({name: value.cast(schema[name].dataType) for name, value in empty.items()}).select(*schema.names)
        emptied = emptied.checkpoint()  # it replaces the folders it was read from
        emptied.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(mart.part).parquet(mart.path)
    return due


def merged(spark: SparkSession, mart: Mart, schema: StructType, by: Sequence[str] | None = None) -> DataFrame:
    """The mart over all partitions, by its keys, some of them, or its partition column too.

    Means and deviations are merged around the common mean, so large values lose no digits.
    """
    by = list(mart.keys if by is None else by)
    parts = mart.stored(spark, schema).filter("n > 0")
    over = Window.partitionBy(*[F.col(f"`{c}`") for c in by]) if by else Window.partitionBy(F.lit(0))
    means = {f"{m}_mean": F.sum(f"{m}_sum").over(over) / F.sum(f"{m}_n").over(over) for m in mart.measures}
    placed = parts.withColumns(means) if means else parts
    made: list[Column] = [F.sum("n").alias("n")]
    for m in mart.measures:
        n, own = F.col(f"{m}_n"), F.col(f"{m}_sum") / F.col(f"{m}_n")
        apart = F.sum(F.when(n > 0, F.col(f"{m}_apart") + n * (own - F.col(f"{m}_mean")) ** 2))
        made += [
            F.sum(n).alias(f"{m}_n"), F.sum(f"{m}_sum").alias(f"{m}_sum"), F.max(f"{m}_mean").alias(f"{m}_mean"),
            F.sqrt(F.when(F.sum(n) > 1, apart / (F.sum(n) - 1))).alias(f"{m}_std"), F.min(f"{m}_min").alias(f"{m}_min"), F.max(f"{m}_max").alias(f"{m}_max"),
        ]
    made += [F.hll_sketch_estimate(F.hll_union_agg(f"{c}_sketch")).alias(f"{c}_distinct") for c in mart.distinct]
    return placed.groupBy(*by).agg(*made)
