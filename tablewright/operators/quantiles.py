"""Exact quantiles with linear interpolation, the same way for a table of any size.

``percentile`` would keep every distinct value of a group in one task.  Instead a bounded
sketch brackets each quantile of a whole column and only the rows inside the brackets are
counted by value and ranked; the ranks are checked, so the result is exact.  Grouped
quantiles rank the value counts of all rows.  Hot values collapse before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import one_row, to_long
from tablewright.operators.ordinal import CHUNK_ROWS, running

SKETCH = 10_000  # the sketch is off by at most one part in this many
COUNTS_PER_PASS = 45  # two counts each: wider aggregates are not compiled


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """(by..., metric, q): ``q`` is an array of doubles in the order of ``probs``."""
    needed = df.select(*by, *cols)
    if by:
        return _ranked(needed, cols, probs, by, chunk)
    return _bracketed(needed, cols, probs, chunk)


def _bracketed(df: DataFrame, cols: Sequence[str], probs: Sequence[float], chunk: int, sketch: int = SKETCH) -> DataFrame:
    """Scans and a shuffle of the few rows near each quantile; a bracket of one value needs only the count of its rows."""
    values = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    slack = 2.0 / sketch
    asked = [max(0.0, p - slack) for p in probs] + [min(1.0, p + slack) for p in probs]
    row = one_row(
        values,
        *[F.count(f"c{i}").alias(f"n{i}") for i in range(len(cols))],
        *[F.percentile_approx(f"c{i}", asked, sketch).alias(f"b{i}") for i in range(len(cols))],
    )
    wanted = [(i, j) for i in range(len(cols)) if row[f"n{i}"] for j in range(len(probs))]
    ends = {(i, j): (row[f"b{i}"][j], row[f"b{i}"][j + len(probs)]) for i, j in wanted}
    spots = {(i, j): (row[f"n{i}"] - 1) * float(probs[j]) for i, j in wanted}
    found: dict[tuple[int, int], float] = {}
    below: dict[tuple[int, int], int] = {}
    if wanted:
        value = {(i, j): F.col(f"c{i}") for i, j in wanted}
        parts = [wanted[k : k + COUNTS_PER_PASS] for k in range(0, len(wanted), COUNTS_PER_PASS)]
        for part in parts:
            counts = [F.count(F.when(test, 1)).alias(f"{name}{i}_{j}") for i, j in part for name, test in (("u", value[i, j] < ends[i, j][0]), ("t", value[i, j] <= ends[i, j][1]))]
            passed = one_row(values, *counts)
            for i, j in part:
                below[i, j] = passed[f"u{i}_{j}"]
                low, high = ends[i, j]
                if low == high and below[i, j] <= spots[i, j] // 1 and -(-spots[i, j] // 1) < passed[f"t{i}_{j}"]:
                    found[i, j] = low + (high - low) * (spots[i, j] - spots[i, j] // 1)
    open_ = [at for at in wanted if at not in found]
    if open_:
        inside = {(i, j): value[i, j].between(*ends[i, j]) for i, j in open_}
        cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.when(inside[i, j], F.col(f"c{i}")).alias("v")) for i, j in open_]
        some = values.filter(reduce(lambda a, b: a | b, [F.coalesce(inside[at], F.lit(False)) for at in open_]))
        near = some.select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter("v IS NOT NULL")
        counted = near.groupBy("i", "j", "v").agg(F.count("*").alias("hits"))
        summed = running(counted, ["i", "j"], ["v"], sums={"upto": "hits"}, chunk=chunk)

        def rank_of(up: bool) -> Column:
            """Rank inside the bracket, as a literal per (column, quantile)."""
            pairs = [(at, (-(-spots[at] // 1) if up else spots[at] // 1) - below[at]) for at in open_]
            return F.create_map(*[x for (i, j), r in pairs for x in (F.lit(f"{i}_{j}"), F.lit(float(r)))])[F.concat_ws("_", "i", "j")]

        ranked = summed.withColumns({"low": rank_of(False), "high": rank_of(True)})
        holds = lambda rank: (F.col("upto") > F.col(rank)) & (F.col("upto") - F.col("hits") <= F.col(rank))
        picked = ranked.groupBy("i", "j").agg(*[F.max(F.when(holds(r), F.col("v"))).alias(r) for r in ("low", "high")])
        for r in picked.collect():  # one row per column and quantile
            at = (r["i"], r["j"])
            if r["low"] is not None and r["high"] is not None:
                found[at] = r["low"] + (r["high"] - r["low"]) * (spots[at] - spots[at] // 1)
    missed = sorted({i for i, j in wanted if (i, j) not in found})
    made = [(c, [found.get((i, j)) for j in range(len(probs))] if row[f"n{i}"] else None) for i, c in enumerate(cols) if i not in missed]
    table = df.sparkSession.createDataFrame(made, "metric string, q array<double>")
    if not missed:
        return table
    return table.unionByName(_ranked(df, [cols[i] for i in missed], probs, (), chunk))


def _ranked(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str], chunk: int) -> DataFrame:
    keys = [*by, "metric"]
    counted = (
        to_long(df, by, cols).filter(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count("*").alias("hits"))
    )
    summed = running(counted, keys, ["value"], sums={"upto": "hits"}, chunk=chunk)
    totals = counted.groupBy(*keys).agg(F.sum("hits").alias("n"))
    on = None
    for key in keys:
        same = F.col(f"s.{key}").eqNullSafe(F.col(f"t.{key}"))
        on = same if on is None else on & same
    placed = summed.alias("s").join(totals.alias("t"), on).select("s.*", "t.n")
    picks = []
    for p in probs:
        spot = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.floor(spot), F.ceil(spot)
        inside = lambda rank: (F.col("upto") > rank) & (F.col("upto") - F.col("hits") <= rank)
        below = F.max(F.when(inside(low), F.col("value")))
        above = F.max(F.when(inside(high), F.col("value")))
        share = F.max(spot - low)
        picks.append(below + (above - below) * share)
    return placed.groupBy(*[F.col(k) for k in keys]).agg(F.array(*picks).alias("q"))


def quantile_values(df: DataFrame, cols: Sequence[str], probs: Sequence[float], **how) -> dict[str, list[float | None]]:
    """Quantiles of whole columns as driver literals: one small row per column."""
    rows = quantiles(df, cols, probs, **how).collect()
    found = {r["metric"]: list(r["q"]) if r["q"] is not None else None for r in rows}
    return {c: found.get(c) or [None] * len(probs) for c in cols}
