"""Projection, filters, labels, long form and the even row sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import filled, numeric_columns, rows_as_table, to_long, type_of
from tablewright.functions.labels import row_label
from tablewright.operators.ordinal import with_ordinal


def select_by_kind(df: DataFrame) -> DataFrame:
    """Numeric or other, per column, with the number of filled cells."""
    numbers = set(numeric_columns(df))
    wide = df.agg(*[F.count(filled(df, c)).alias(f"_f{i}") for i, c in enumerate(df.columns)])
    cells = [
        (F.lit(c), F.lit("numeric" if c in numbers else "other"), F.col(f"_f{i}")) for i, c in enumerate(df.columns)
    ]
    return rows_as_table(wide, cells, ["column_name", "kind", "filled"])


def date_range_filter(df: DataFrame, date_col: str, start: str, end: str) -> DataFrame:
    """Both ends included; rows without a date drop out.  The bounds reach the scan."""
    kind = type_of(df, date_col)
    return df.filter(F.col(date_col).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep rows that have a value in every one of ``cols`` (NaN counts as missing)."""
    return df.dropna("any", subset=list(cols))


def isin_filter(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """Rows whose value is in a list: a filter that reaches the scan, with a hash set behind it for a long list."""
    return df.filter(F.col(name).isin(*values))


def slice_dice(df: DataFrame, **wanted) -> DataFrame:
    """A single value slices, a list dices; all conditions must hold."""
    out = df
    for name, value in wanted.items():
        out = isin_filter(out, name, value) if isinstance(value, (list, tuple, set)) else out.filter(F.col(name) == value)
    return out


def melt_long(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return to_long(df, ids, metrics)


def with_row_label(df: DataFrame, dims: Sequence[str], name: str = "label") -> DataFrame:
    return df.withColumn(name, row_label(dims))


def even_positions(position: Column, rows: int, wanted: int) -> Column:
    """Predicate: the position is one of ``wanted`` evenly spread ones out of ``rows``.

    A position is hit when the first spread point at or after it lies before the next
    position; whole-number arithmetic keeps this exact.
    """
    if wanted >= rows:
        return F.lit(True)
    if wanted == 1:
        return position == 0
    steps, span = F.lit(wanted - 1).cast("long"), F.lit(rows - 1).cast("long")
    reach = position * steps + span - 1
    first = (reach - F.pmod(reach, span)).cast("long")
    return first < (position + 1) * steps


def even_row_sample(df: DataFrame, order: Sequence[str], wanted: int) -> DataFrame:
    """At most ``wanted`` rows, evenly spread over the sorted table; no limit when not positive."""
    if wanted <= 0:
        return df
    numbered, rows = with_ordinal(df, order, "_pos")
    if rows <= wanted:
        return df
    return numbered.filter(even_positions(F.col("_pos"), rows, wanted)).drop("_pos")
