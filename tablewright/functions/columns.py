"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.DoubleType, T.FloatType)
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def other_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, T.NumericType)]


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), FLOATS)


def finite(name: str | Column) -> Column:
    """NaN and both infinities become NULL."""
    c = F.col(name) if isinstance(name, str) else name
    bad = F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return F.when(~bad, c)


def filled(df: DataFrame, name: str) -> Column:
    """The column with NaN as NULL, so that ``count`` counts values."""
    c = F.col(name)
    return F.when(~F.isnan(c), c) if is_float(df, name) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    """One kind of missing value: NaN becomes NULL in every float column."""
    return df.select(
        *[filled(df, c).alias(c) for c in df.columns]
    )


def parse_number(name: str | Column) -> Column:
    """Text to double; whatever does not parse is NULL."""
    c = F.col(name) if isinstance(name, str) else name
    value = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value)


def parse_date(name: str | Column) -> Column:
    """Text to timestamp; whatever does not parse is NULL."""
    c = F.col(name) if isinstance(name, str) else name
    return c.cast("string").try_cast("timestamp_ntz")


def ladder(value: Column, steps: Sequence[tuple[float, str]], otherwise: str, missing: str | None = None) -> Column:
    """Label by the first threshold that ``value`` reaches, highest first."""
    out = F.when(value.isNull(), F.lit(missing)) if missing is not None else None
    for floor, label in steps:
        hit = value >= F.lit(floor)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def ratio(top: Column, bottom: Column) -> Column:
    """Division that is NULL, not an error, over zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Wide numeric columns to (ids, name, value) rows, all values as double."""
    ready = df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values])
    return ready.unpivot(list(ids), list(values), name, value)


def text_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "column_name", value: str = "value") -> DataFrame:
    ready = df.select(*ids, *[F.col(v).cast("string").alias(v) for v in values])
    return ready.unpivot(list(ids), list(values), name, value)


def sort_key(names: Sequence[str]) -> Column:
    """What ``max_by`` and ``min_by`` compare: a plain column where one is enough, which keeps the aggregate hashed."""
    return F.col(names[0]) if len(names) == 1 else F.struct(*names)


def one_row(df: DataFrame, *aggregates: Column) -> Row:
    """A fixed-width global aggregate as literals; one row reaches the driver."""
    return df.agg(*aggregates).first()


#: Columns with no more distinct values by their sketch are counted as sets inside the aggregate.
FEW_VALUES = 4_096


def distinct_values(df: DataFrame, values: Mapping[str, Column], enough: int | None = None, few: int = FEW_VALUES) -> dict[str, int]:
    """Exact numbers of distinct values (NULL is none, -0.0 is 0.0) without a copy of the rows per column.

    One pass takes sketches of all columns.  What they show to be few is counted as sets in a second pass, whose state is
    bounded by ``few``; each of the others is scanned alone and grouped by its value.  With ``enough``, a column whose sketch
    shows more than twice as many keeps the sketch's number: far more than ``enough`` for any error the sketch has.
    """
    if not values:
        return {}
    names = list(values)
    plain = df.select(*[c.alias(f"v{i}") for i, c in enumerate(values.values())])
    even = plain.select(*[(F.col(f.name) + F.lit(0).cast(f.dataType)).alias(f.name) if isinstance(f.dataType, FLOATS) else F.col(f.name) for f in plain.schema])
    rough = one_row(even, *[F.approx_count_distinct(c).alias(c) for c in even.columns])
    found = {c: rough[c] for c in even.columns if enough is not None and rough[c] > 2 * enough}
    sets = [c for c in even.columns if c not in found and rough[c] <= few]
    if sets:
        told = {f.name: F.col(f.name).cast("string") if isinstance(f.dataType, FLOATS) else F.col(f.name) for f in even.schema}  # a set holds every NaN
        found.update(one_row(even, *[F.size(F.collect_set(told[c])).alias(c) for c in sets]).asDict())
    many = [c for c in even.columns if c not in found]
    if many:
        alone = [even.select(c).filter(F.col(c).isNotNull()).distinct().agg(F.count("*").alias("n")).select(F.lit(c).alias("c"), "n") for c in many]
        found.update((r["c"], r["n"]) for r in reduce(DataFrame.unionAll, alone).collect())  # one row per column
    return {name: int(found[c]) for name, c in zip(names, even.columns, strict=True)}


def rows_as_table(df: DataFrame, rows: Iterable[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """Turn every row of ``df`` into one row per entry of ``rows`` (column expressions)."""
    cells = [
        F.struct(*[cell.alias(name) for cell, name in zip(row, names, strict=True)]) for row in rows
    ]
    return df.select(F.explode(F.array(*cells)).alias("r")).select(*[F.col(f"r.{n}").alias(n) for n in names])


#: Rows that are not worth dealing out.
FEW_ROWS = 65_536


def spread_rows(df: DataFrame, few: int = FEW_ROWS) -> DataFrame:
    """The rows dealt over all cores, for costly work on them: a file of one row group would be read by one task.

    Tables of few rows stay as they lie."""
    if df.limit(few + 1).count() <= few:
        return df
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
