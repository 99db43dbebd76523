"""Rows joined to every interval that holds them, for interval tables of any size.

Time is cut into cells of powers of two.  An interval lies in the cells of the level whose cells are as long as itself, so it
covers two of them (open ones a few more), whatever its length; neighbouring levels share the smaller cells where that makes fewer
copies of rows and intervals together.  A row looks up its own cell on the levels that occur, at
most 63, and an equality join over level and cell finds the candidates; the exact comparison follows in the same join.  No pair is looked at whose
interval ends more than one length of itself away from the row.

A cell with many rows is dealt over several salts, for which the intervals of that cell alone are repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels that share a cell size: an interval then covers up to 2^6 + 1 cells of the smallest of them.
SHARED = 6
TOP = 62  # level of open intervals: four cells hold all numbers
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _ticks(value: Column, kind: T.DataType) -> Column:
    """A number, date or timestamp as a long that keeps the order (numbers rounded down, beyond 2^62 as 2^62)."""
    if isinstance(kind, _INTEGRAL):
        return value.cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), value)
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        edge = float(1 << TOP)
        inside = F.greatest(F.lit(-edge), F.least(F.lit(edge), value.cast("double")))
        return F.when(value.isNotNull(), F.floor(inside).cast("long"))  # ``least`` passes over a null
    raise TypeError(f"no intervals over {kind.simpleString()}")


def _known(value: Column, kind: T.DataType) -> Column:
    """NaN is no place on the axis."""
    return F.when(~F.isnan(value), value) if isinstance(kind, (T.FloatType, T.DoubleType)) else value


def base_levels(counts: dict[int, int], rows: int) -> dict[int, int]:
    """The level whose cells the intervals of each level are cut into: the least copies of rows and intervals together.

    Every level in use costs a copy of all rows; an interval cut into smaller cells than its own costs more copies of itself."""
    levels = sorted(counts)
    best: list[tuple[int, int]] = [(0, 0)]  # copies for the first levels, and where their last group starts
    for end in range(1, len(levels) + 1):
        tried = []
        for begin in range(end):
            if levels[end - 1] - levels[begin] <= SHARED:
                copies = sum(counts[v] * ((2 if v < TOP else 4) << (v - levels[begin])) for v in levels[begin:end])
                tried.append((best[begin][0] + rows + copies, begin))
        best.append(min(tried))
    bases, end = {}, len(levels)
    while end:
        begin = best[end][1]
        bases.update({v: levels[begin] for v in levels[begin:end]})
        end = begin
    return bases


def interval_join(
    rows: DataFrame, intervals: DataFrame, at: str, start: str, end: str, keys: Sequence[str] = (), closed: str = "both",
    hot_rows: int = 1_000_000, suffix: str = "_interval",
) -> DataFrame:
    """One row for each row and interval with ``start <= at <= end`` and equal ``keys``: all columns of both.

    ``closed`` says which ends belong to an interval: both, left, right or neither.  A null start or end leaves that side
    open.  Rows with a null (or NaN) place or key match nothing, nor do intervals with a NaN end, a null key, or an end before
    their start.  Repeated rows and intervals match as often as they stand.  ``at``, ``start`` and ``end`` have one type.  Keys
    come back once; other columns of an interval that a row has too get ``suffix``.
    Cells with more than ``hot_rows`` rows are dealt over several tasks.
    """
    if closed not in ("both", "left", "right", "neither"):
        raise ValueError(f"closed is both, left, right or neither, not {closed!r}")
    kind = rows.schema[at].dataType
    if {intervals.schema[start].dataType, intervals.schema[end].dataType} != {kind}:
        raise TypeError(f"{at}, {start} and {end} must have one type")
    keys = list(keys)
    taken = set(rows.columns)
    names = {c: c if c not in taken else c + suffix for c in intervals.columns if c not in keys}
    if len(set(names.values()) | taken) < len(names) + len(taken):
        raise ValueError("columns of both tables clash; choose another suffix")

    place = _known(F.col(f"`{at}`"), kind)
    mine = [F.col(f"`{k}`").alias(f"__k{n}") for n, k in enumerate(keys)]
    on = [f"__k{n}" for n in range(len(keys))]
    given = [F.col(f"`{k}`").isNotNull() for k in keys]

    a, b = F.col(f"`{start}`"), F.col(f"`{end}`")
    ordered = F.coalesce(a <= b, F.lit(True))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        ordered = ordered & ~F.coalesce(F.isnan(a), F.lit(False)) & ~F.coalesce(F.isnan(b), F.lit(False))
    low = F.coalesce(_ticks(a, kind), F.lit(-(1 << 63)))
    high = F.coalesce(_ticks(b, kind), F.lit((1 << 63) - 1))
    length = high.cast("double") - low.cast("double") + 1
    spans = intervals
    for test in [*given, ordered]:
        spans = spans.where(test)
    level = F.least(F.lit(TOP), F.ceil(F.log2(length))).cast("int")
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("__span")
    spans = spans.select(whole, *mine, a.alias("__a"), b.alias("__b"), low.alias("__low"), high.alias("__high"), level.alias("__level"))

    # at most 63 numbers come back, whatever the size of the table
    counts = {r["__level"]: r["__n"] for r in spans.groupBy("__level").agg(F.count(F.lit(1)).alias("__n")).collect()}
    bases = base_levels(counts, rows.count())
    levels = sorted(set(bases.values()))
    if bases:
        spans = spans.withColumn("__level", F.create_map(*[F.lit(v) for pair in bases.items() for v in pair])[F.col("__level")])
    spans = spans.withColumn("__cell", F.explode(F.expr("sequence(shiftright(__low, __level), shiftright(__high, __level))"))).drop("__low", "__high")

    points = rows.where(place.isNotNull())
    for test in given:
        points = points.where(test)
    ticks = _ticks(place, kind)
    cells = F.array(*[F.struct(F.lit(v).alias("level"), F.shiftright(ticks, v).alias("cell")) for v in levels])
    if not levels:
        cells = F.array().cast("array<struct<level:int,cell:bigint>>")
    places = points.select(*mine, ticks.alias("__tick"), cells.alias("__cells"))
    points = points.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row"), *mine, place.alias("__at"), F.explode(cells).alias("__c"))
    points = points.select("__row", *on, "__at", F.col("__c.level").alias("__level"), F.col("__c.cell").alias("__cell"))

    # only inside a crowded cell of the highest level can others be crowded; one row for each million rows at most is sent to all tasks
    cell, wide = [*on, "__level", "__cell"], [*on, "__wide"]
    places = places.withColumn("__wide", F.shiftright("__tick", levels[-1] if levels else 0))
    dense = places.groupBy(*wide).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows).select(*wide)
    inside = places.join(F.broadcast(dense), wide, "left_semi").select(*on, F.explode("__cells").alias("__c"))
    inside = inside.select(*on, F.col("__c.level").alias("__level"), F.col("__c.cell").alias("__cell"))
    crowded = inside.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows)
    crowded = F.broadcast(crowded.select(*cell, F.ceil(F.col("__n") / hot_rows).cast("int").alias("__salts")))
    salts = F.coalesce(F.col("__salts"), F.lit(1))
    points = points.join(crowded, cell, "left").withColumn("__salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int")).drop("__salts")
    spans = spans.join(crowded, cell, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")

    at_, a, b = F.col("__at"), F.col("__a"), F.col("__b")
    after = a.isNull() | ((at_ >= a) if closed in ("both", "left") else (at_ > a))
    before = b.isNull() | ((at_ <= b) if closed in ("both", "right") else (at_ < b))
    held = points.join(spans, [*cell, "__salt"]).where(after & before)
    return held.select(*[F.col(f"__row.`{c}`") for c in rows.columns], *[F.col(f"__span.`{c}`").alias(name) for c, name in names.items()])
