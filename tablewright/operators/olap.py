"""Grouped summaries, pivots and cubes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import distinct_values, finite, is_float, one_row, ratio, rows_as_table, to_long
from tablewright.functions.labels import row_label
from tablewright.operators.ordinal import with_ordinal
from tablewright.operators.quantiles import quantiles

MAX_GRID = 100_000  # completed pivot rows a report may have

AGGREGATES = {
    "mean": F.avg, "sum": F.sum, "count": F.count, "std": F.stddev_samp, "min": F.min, "max": F.max,
}


def _measure(df: DataFrame, name: str) -> Column:
    return finite(name) if is_float(df, name) else F.col(name)


def period_compare(df: DataFrame, by: str, cols: Sequence[str], **how) -> DataFrame:
    """n, mean, median, std, min, max per group and measure, in long form."""
    moments = df.groupBy(by).agg(
        *[
            f(_measure(df, c).cast("double")).alias(f"{name}_{i}")
            for i, c in enumerate(cols)
            for name, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
        ]
    )
    cells = [
        F.struct(F.lit(c).alias("metric"), *[F.col(f"{n}_{i}").alias(n) for n in ("n", "mean", "std", "min", "max")])
        for i, c in enumerate(cols)
    ]
    long = moments.select(by, F.explode(F.array(*cells)).alias("r")).select(by, "r.*")
    middle = quantiles(df, cols, [0.5], by=[by], **how).select(by, "metric", F.col("q")[0].alias("median"))
    on = F.col(f"l.{by}").eqNullSafe(F.col(f"m.{by}")) & (F.col("l.metric") == F.col("m.metric"))
    return long.alias("l").join(middle.alias("m"), on, "left").select("l.*", "m.median")


def period_means(df: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    """(group, metric, mean) rows."""
    wide = df.groupBy(by).agg(*[F.avg(_measure(df, c)).alias(c) for c in cols])
    return to_long(wide, [by], cols, "metric", "mean")


def olap_cells(df: DataFrame, rows: Sequence[str], columns: Sequence[str], values: Sequence[str], how: str = "mean") -> DataFrame:
    """Aggregated cells in long form: one row per observed combination."""
    f = AGGREGATES[how]
    return df.groupBy(*rows, *columns).agg(*[f(_measure(df, v)).alias(v) for v in values])


def olap_pivot(
    df: DataFrame,
    rows: Sequence[str],
    column: str,
    levels: Sequence,
    value: str,
    how: str = "mean",
    max_grid: int = MAX_GRID,
) -> DataFrame:
    """Wide pivot with named ``levels``; row levels are completed to all combinations, gaps are 0.

    The completion works on the distinct levels of the aggregate and is refused when it
    would exceed ``max_grid`` rows.
    """
    f = AGGREGATES[how]
    wide = df.groupBy(*rows).pivot(column, list(levels)).agg(f(_measure(df, value)))
    named = wide.toDF(*rows, *[flat_name(value, level) for level in levels])
    filled = [c for c in named.columns if c not in rows]
    if len(rows) > 1:
        named = _complete(df, named, rows, max_grid)
    return named.fillna(0, subset=filled)


def _complete(df: DataFrame, cells: DataFrame, rows: Sequence[str], max_grid: int) -> DataFrame:
    sizes = distinct_values(df, {r: F.struct(F.col(r)) for r in rows})
    grid_rows = 1
    for r in rows:
        grid_rows *= sizes[r]
    if grid_rows > max_grid:
        raise ValueError(f"the completed pivot would have {grid_rows} rows, more than {max_grid}")
    levels = df.agg(*[F.collect_set(F.struct(F.col(r))).alias(r) for r in rows])  # sizes checked above
    grid = levels
    for r in rows:
        grid = grid.withColumn(r, F.explode(r))
    grid = grid.select(*[F.col(r)[r].alias(r) for r in rows])
    on = reduce(lambda a, b: a & b, [F.col(f"g.{r}").eqNullSafe(F.col(f"c.{r}")) for r in rows])
    rest = [c for c in cells.columns if c not in rows]
    return grid.alias("g").join(cells.alias("c"), on, "left").select(*[F.col(f"g.{r}") for r in rows], *[F.col(f"c.`{c}`") for c in rest])


def flat_name(*parts: object) -> str:
    """"value | level" column name; empty parts are left out."""
    return " | ".join(str(p) for p in parts if p not in (None, ""))


def olap_insight(cells: DataFrame, dims: Sequence[str], measure: str) -> DataFrame:
    """Top and bottom segment, spread and gap of an aggregated measure, in one row."""
    named = cells.filter(F.col(measure).isNotNull()).select(row_label(dims).alias("segment"), F.col(measure).cast("double").alias("v"))
    best = named.agg(
        F.min_by(F.struct("segment", "v"), F.struct((-F.col("v")).alias("a"), F.col("segment"))).alias("t"),
        F.min_by(F.struct("segment", "v"), F.struct("v", "segment")).alias("b"),
        F.count("*").alias("segments"),
    ).filter("segments > 0")
    spread = F.col("t.v") - F.col("b.v")
    return best.select(
        F.col("t.segment").alias("top_segment"),
        F.col("t.v").alias("top_value"),
        F.col("b.segment").alias("bottom_segment"),
        F.col("b.v").alias("bottom_value"),
        spread.alias("spread"),
        ratio(spread * 100, F.abs(F.col("b.v"))).alias("gap_pct"),
        "segments",
    )


def top_segments(cells: DataFrame, dims: Sequence[str], measure: str, limit: int = 5) -> DataFrame:
    named = cells.filter(F.col(measure).isNotNull()).select(row_label(dims).alias("segment"), F.col(measure).alias("value"))
    return named.orderBy(F.desc("value"), "segment").limit(limit)


def cube_cells(df: DataFrame, dims: Sequence[str], measure: str, how: str = "mean", limit: int = 90) -> DataFrame:
    """The ``limit`` largest cells over three dimensions."""
    f = AGGREGATES[how]
    cells = df.groupBy(*dims).agg(f(_measure(df, measure)).alias("value")).filter("value IS NOT NULL")
    return cells.orderBy(F.desc("value"), *dims).limit(limit)


def cube_face(cells: DataFrame, x: str, y: str) -> DataFrame:
    """Unweighted mean of the kept cells per face position."""
    return cells.groupBy(x, y).agg(F.avg("value").alias("value"))


def dimension_codes(df: DataFrame, dim: str, order: Sequence[str]) -> DataFrame:
    """Dense code per category in order of first appearance by ``order``."""
    seen = df.filter(F.col(dim).isNotNull()).groupBy(dim).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n"))
    coded, _ = with_ordinal(seen, ["first"], "code")
    return coded.drop("first")


def date_dimensions(df: DataFrame, date_col: str) -> DataFrame:
    """Year and quarter as text dimensions."""
    return df.withColumn("olap_year", F.year(date_col).cast("string")).withColumn(
        "olap_quarter", F.concat(F.lit("Q"), F.quarter(date_col).cast("string"))
    )


def rollup_cube(df: DataFrame, dims: Sequence[str], measure: str, how: str = "sum", every: bool = False) -> DataFrame:
    """Detail, subtotals and grand total; ``every`` takes all combinations instead of the hierarchy."""
    grouped = df.cube(*dims) if every else df.rollup(*dims)
    return grouped.agg(
        F.grouping_id().cast("long").alias("level"), AGGREGATES[how](_measure(df, measure)).alias("value"), F.count("*").alias("n")
    )


def named_summary(df: DataFrame, by: str, order: Sequence[str], named: dict[str, str]) -> DataFrame:
    """Named averages in a fixed group order; groups without rows stay with NULLs."""
    found = df.groupBy(by).agg(*[F.avg(_measure(df, c)).alias(name) for name, c in named.items()])
    wanted = df.sparkSession.createDataFrame([(i, o) for i, o in enumerate(order)], f"position long, `{by}` string")
    return wanted.join(found, by, "left")


def normalized_profile(df: DataFrame, by: str, date_col: str, cols: Sequence[str], skip: Sequence[str] = ("Unknown",), groups: int = 2) -> DataFrame:
    """Min-max scaled mean per measure for the first groups by appearance."""
    data = df.filter(F.col(by).isNotNull() & ~F.col(by).isin(*skip))
    complete = df.dropna("any", subset=[by, *cols])
    ends = one_row(complete, *[x for c in cols for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))])
    first = data.groupBy(by).agg(F.min(date_col).alias("d")).orderBy(F.col("d").asc_nulls_last(), by).limit(groups).collect()
    chosen = [r[by] for r in first]  # at most ``groups`` rows
    scaled = {}
    for c in cols:
        lo, hi = ends[f"lo_{c}"], ends[f"hi_{c}"]
        scaled[c] = F.lit(None).cast("double") if lo is None or lo == hi else (F.col(c) - F.lit(lo)) / F.lit(hi - lo)
    means = complete.filter(F.col(by).isin(*chosen)).groupBy(by).agg(*[F.avg(e).alias(c) for c, e in scaled.items()])
    return to_long(means, [by], cols, "metric", "value")


def value_counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.count("*").alias("n"))


def ols_trend(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line and fit per group."""
    return df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )
