"""Positional cuts ("the first k rows by date") as plain predicates.

Instead of numbering a whole table, find the sort key of the k-th row by counting
values column by column, and compare rows with that key.  The counting collapses
equal values before the shuffle and the result is a filter that reaches the scan.

Keys are compared as codes that sort like the column and survive the way to the
driver and back: zoned times are microseconds, so no session zone takes part, and a
floating-point column is "is NaN" before its value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.ordinal import running


@dataclass(frozen=True)
class Code:
    """A column that is counted, the column that rows are compared by, and a counted value as a literal of the latter."""

    counted: Column
    compared: Column
    literal: Callable[[object], Column] = F.lit


def sort_codes(df: DataFrame, order: Sequence[str]) -> list[Code]:
    """Codes that order rows like ``order`` (ascending, NaN after numbers, NULL last)."""
    codes: list[Code] = []
    for name in order:
        kind, c = df.schema[name].dataType, F.col(name)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            odd = F.when(c.isNotNull(), F.isnan(c).cast("int"))
            number = F.nanvl(c.cast("double"), F.lit(0.0))
            codes += [Code(odd, odd), Code(number, number)]
        elif isinstance(kind, T.TimestampType):
            codes.append(Code(F.unix_micros(c), c, lambda v: F.timestamp_micros(F.lit(v))))
        elif isinstance(kind, T.TimestampNTZType):  # ISO text sorts like the time and is read back without a zone
            codes.append(Code(c.cast("string"), c, lambda v: F.lit(v).cast("timestamp_ntz")))
        elif isinstance(kind, T.DateType):
            codes.append(Code(F.unix_date(c), c, lambda v: F.date_from_unix_date(F.lit(v))))
        elif isinstance(kind, T.BooleanType):
            codes.append(Code(c.cast("int"), c.cast("int")))
        else:
            codes.append(Code(c, c))
    return codes


def keys_at(df: DataFrame, order: Sequence[str], positions: Iterable[int]) -> dict[int, list]:
    """Codes of the rows at ``positions`` (1-based); shorter where a prefix decides.

    One grouped pass for each code, however many positions are asked for.
    """
    codes = sort_codes(df, order)
    rest = df.select(*[c.counted.alias(f"k{i}") for i, c in enumerate(codes)])
    asked = sorted(set(positions))
    found: dict[int, list] = {k: [] for k in asked}
    needed = {k: k for k in asked}
    for i in range(len(codes)):
        if not needed:
            break
        before, name = [f"k{j}" for j in range(i)], f"k{i}"

        def behind(k: int, before=before) -> Column:
            same = F.lit(True)
            for column, value in zip(before, found[k], strict=True):
                same = same & _same(rest, column, value)
            return same

        inside = F.lit(False)
        for prefix in {tuple(found[k]): k for k in needed}.values():
            inside = inside | behind(prefix)
        counted = rest.filter(inside).groupBy(*before, name).agg(F.count("*").alias("hits"))
        summed = running(counted, before, [name], sums={"upto": "hits"})
        holds = F.lit(False)
        for k, need in needed.items():
            holds = holds | (behind(k) & (F.col("upto") >= need) & (F.col("upto") - F.col("hits") < need))
        rows = [(tuple(r[c] for c in before), r[name], r["upto"], r["hits"]) for r in summed.filter(holds).collect()]  # one row a cut
        for k in list(needed):
            own = [r for r in rows if r[0] == tuple(found[k]) and r[2] - r[3] < needed[k] <= r[2]]
            if not own:
                raise ValueError("position beyond the last row")
            _, value, upto, hits = own[0]
            found[k].append(value)
            left = needed.pop(k) - (upto - hits)
            if left < hits:
                needed[k] = left
    return found


def _same(df: DataFrame, name: str, value) -> Column:
    return F.col(name).eqNullSafe(F.lit(value).cast(df.schema[name].dataType))


def up_to_key(codes: Sequence[Code], key: Sequence) -> Column:
    """Predicate: the row sorts at or before ``key``."""
    result = None
    for code, value in reversed(list(zip(codes, key, strict=False))):
        c = code.compared
        before = c.isNotNull() if value is None else F.coalesce(c < code.literal(value), F.lit(False))
        same = c.isNull() if value is None else F.coalesce(c == code.literal(value), F.lit(False))
        result = (before | same) if result is None else (before | (same & result))
    return result


def cuts(df: DataFrame, order: Sequence[str], positions: Sequence[int]) -> list[Column]:
    """For each position the predicate: the row is among so many first ones by ``order``."""
    codes = sort_codes(df, order)
    keys = keys_at(df, order, [k for k in positions if k > 0])
    return [up_to_key(codes, keys[k]) if k > 0 else F.lit(False) for k in positions]


def first_rows(df: DataFrame, order: Sequence[str], k: int) -> Column:
    """Predicate: the row is among the first ``k`` by ``order``."""
    return cuts(df, order, [k])[0]
