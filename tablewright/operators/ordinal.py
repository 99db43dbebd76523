"""Global order without a single-partition window.

Rows are range-partitioned and sorted once, the placement is cut off by a reliable
checkpoint (range bounds come from sampling, so they must not be drawn twice), and
the position of a row is its place in its partition plus the sizes of the
partitions before it.  Only one number per partition reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewright.session import work_dir

CHUNK_ROWS = 1_000_000
_SHIFT = 33  # monotonically_increasing_id keeps the partition number above this bit


def _order_columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order]


def with_ordinal(df: DataFrame, order: Sequence[str | Column], name: str = "ordinal") -> tuple[DataFrame, int]:
    """Add the 0-based global position by ``order``; also return the row count.

    ``order`` should end in a unique tiebreak, otherwise equal rows share positions
    in an arbitrary way.  A hot date does not matter: the range bounds are drawn
    over the whole sort key.
    """
    spark = df.sparkSession
    work_dir(spark)
    keys = _order_columns(order)
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).checkpoint()
    tagged = placed.withColumn("_place", F.monotonically_increasing_id())
    sizes = tagged.groupBy(F.shiftright("_place", _SHIFT).alias("_part")).count().collect()  # one row per partition
    offsets, total = [], 0
    for part, count in sorted((r["_part"], r["count"]) for r in sizes):
        offsets.append((part, total))
        total += count
    if not offsets:
        return df.withColumn(name, F.lit(None).cast("long")), 0
    schema = T.StructType([T.StructField("_part", T.LongType()), T.StructField("_start", T.LongType())])
    starts = spark.createDataFrame(offsets, schema)
    numbered = tagged.withColumn("_part", F.shiftright("_place", _SHIFT)).join(F.broadcast(starts), "_part")
    mask = (1 << _SHIFT) - 1
    position = F.col("_start") + F.col("_place").bitwiseAND(F.lit(mask))
    return numbered.withColumn(name, position).drop("_place", "_part", "_start"), total


def windowed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    build: Callable[[WindowSpec], list[dict[str, Column]]],
    back: int = 0,
    ahead: int = 0,
    grain: str | None = None,
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """Evaluate bounded-frame window columns over each series.

    With ``keys`` and a calendar ``grain`` (one row per key and period) a series is
    bounded by the calendar and an ordinary keyed window is used.  Otherwise the
    series may hold any share of the table: rows are numbered globally, cut into
    chunks of ``chunk`` rows, and each chunk also receives the ``back`` rows before
    and the ``ahead`` rows after it, so no task ever sees more than one chunk.

    ``build`` returns stages of new columns; a later stage may use an earlier one, and
    ``back`` and ``ahead`` cover all stages together.
    """

    def apply(rows: DataFrame, window: WindowSpec) -> DataFrame:
        for stage in build(window):
            rows = rows.withColumns(stage)
        return rows

    if keys and grain:
        return apply(df, Window.partitionBy(*keys).orderBy(*_order_columns(order)))
    numbered, _ = with_ordinal(df, [*keys, *order], "_ord")
    first = F.greatest(F.floor((F.col("_ord") - ahead) / chunk), F.lit(0))
    last = F.floor((F.col("_ord") + back) / chunk)
    copies = numbered.withColumn("_chunk", F.explode(F.sequence(first, last)))
    window = Window.partitionBy("_chunk", *keys).orderBy("_ord")
    out = apply(copies, window)
    home = F.floor(F.col("_ord") / chunk) == F.col("_chunk")
    return out.filter(home).drop("_ord", "_chunk")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, str] | None = None,
    lasts: dict[str, str] | None = None,
    grain: str | None = None,
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """Running sums and last-non-null values from the start of each series.

    ``sums`` and ``lasts`` map new column names to input columns.  Without a calendar
    grain the work is two-level: inside chunks of rows, then over one row per chunk.
    """
    sums, lasts = sums or {}, lasts or {}

    def local(window: WindowSpec) -> dict[str, Column]:
        frame = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        made = {new: F.sum(old).over(frame) for new, old in sums.items()}
        made.update({new: F.last(old, ignorenulls=True).over(frame) for new, old in lasts.items()})
        return made

    if keys and grain:
        return df.withColumns(local(Window.partitionBy(*keys).orderBy(*_order_columns(order))))

    numbered, _ = with_ordinal(df, [*keys, *order], "_ord")
    parts = numbered.withColumn("_chunk", F.floor(F.col("_ord") / chunk))
    inside = parts.withColumns(local(Window.partitionBy("_chunk", *keys).orderBy("_ord")))
    # One row per (key, chunk); a key without several chunks has nothing to carry.
    ends = parts.groupBy(*keys, "_chunk").agg(
        *[F.sum(old).alias(new) for new, old in sums.items()],
        *[
            F.max_by(old, F.when(F.col(old).isNotNull(), F.col("_ord"))).alias(new)
            for new, old in lasts.items()
        ],
    )
    before = Window.orderBy("_chunk") if not keys else Window.partitionBy(*keys).orderBy("_chunk")
    frame = before.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys,
        "_chunk",
        F.lag("_chunk").over(before).alias("_previous"),
        *[F.sum(new).over(frame).alias(f"_carry_{new}") for new in sums],
        *[F.last(new, ignorenulls=True).over(frame).alias(f"_carry_{new}") for new in lasts],
    ).filter(F.col("_previous").isNotNull()).drop("_previous")
    condition = F.col("l._chunk") == F.col("r._chunk")
    for key in keys:
        condition = condition & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    joined = inside.alias("l").join(carried.alias("r"), condition, "left")
    result = []
    for name in inside.columns:
        if name in ("_ord", "_chunk"):
            continue
        here = F.col(f"l.{name}")
        if name in sums:
            here = F.when(here.isNull(), F.col(f"r._carry_{name}")).otherwise(
                here + F.coalesce(F.col(f"r._carry_{name}"), F.lit(0))
            )
        elif name in lasts:
            here = F.coalesce(here, F.col(f"r._carry_{name}"))
        result.append(here.alias(name))
    return joined.select(*result)
