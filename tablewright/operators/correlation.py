"""Pearson correlations on pairwise complete rows, and what is read off them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions import labels, rules
from tablewright.functions.columns import finite, is_float, one_row

#: Fields of an aggregate that is still compiled: six for the spread of a column, five for a pair.
FIELDS_PER_PASS = 98
SPREAD_FIELDS, PAIR_FIELDS = 6, 5


def _value(df: DataFrame, name: str) -> Column:
    c = F.col(name).cast("double")
    return finite(c) if is_float(df, name) else c


def _spread(name: str, c: Column) -> list[Column]:
    """What one column contributes to a correlation."""
    made = (("n", F.count(c)), ("s", F.stddev_pop(c)), ("lo", F.min(c)), ("hi", F.max(c)))
    return [out.alias(f"{name}_{key}") for key, out in made]


def _share(row: Row, a: str, b: str, covariance: str) -> float | None:
    """NULL, not an error or noise, when one side is constant or empty."""
    if not row[f"{a}_n"] or row[f"{a}_lo"] == row[f"{a}_hi"] or row[f"{b}_lo"] == row[f"{b}_hi"]:
        return None
    return row[covariance] / (row[f"{a}_s"] * row[f"{b}_s"])


def _passes(pairs: Sequence[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """The pairs in their order, in parts whose aggregates are narrow enough to be compiled."""
    parts: list[list[tuple[str, str]]] = []
    cols: set[str] = set()
    for pair in dict.fromkeys(pairs):
        wider = cols | set(pair)
        if not parts or len(wider) * SPREAD_FIELDS + (len(parts[-1]) + 1) * PAIR_FIELDS > FIELDS_PER_PASS:
            parts.append([])
            wider = set(pair)
        parts[-1].append(pair)
        cols = wider
    return parts


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(left, right, correlation) for the given pairs, each over its complete rows.

    Many pairs share one pass and the spread of a column is computed once.  Only pairs
    whose columns have gaps in different rows need a second pass with masked columns.
    """
    found: dict[tuple[str, str], float | None] = {}
    for batch in _passes(pairs):
        cols = list(dict.fromkeys(c for pair in batch for c in pair))
        at = {c: f"c{i}" for i, c in enumerate(cols)}
        ready = df.select(*[_value(df, c).alias(at[c]) for c in cols])
        value = {c: F.col(at[c]) for c in cols}
        both = [value[a].isNotNull() & value[b].isNotNull() for a, b in batch]
        row = one_row(
            ready,
            *[x for c in cols for x in _spread(at[c], value[c])],
            *[F.covar_pop(value[a], value[b]).alias(f"v{i}") for i, (a, b) in enumerate(batch)],
            *[F.count(F.when(both[i], 1)).alias(f"m{i}") for i in range(len(batch))],
        )
        uneven = []
        for i, (a, b) in enumerate(batch):
            if row[f"m{i}"] == row[f"{at[a]}_n"] == row[f"{at[b]}_n"]:
                found[a, b] = _share(row, at[a], at[b], f"v{i}")
            elif row[f"m{i}"] == 0:
                found[a, b] = None
            else:
                uneven.append(i)
        most = FIELDS_PER_PASS // (2 * SPREAD_FIELDS)
        for part in (uneven[k : k + most] for k in range(0, len(uneven), most)):
            masked = one_row(
                ready,
                *[x for i in part for x in _spread(f"a{i}", F.when(both[i], value[batch[i][0]]))],
                *[x for i in part for x in _spread(f"b{i}", F.when(both[i], value[batch[i][1]]))],
            )
            for i in part:
                joined = Row(**masked.asDict(), **{f"v{i}": row[f"v{i}"]})
                found[batch[i]] = _share(joined, f"a{i}", f"b{i}", f"v{i}")
    rows = [(a, b, found[a, b]) for a, b in pairs]
    return df.sparkSession.createDataFrame(rows, "left string, right string, correlation double")


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Full matrix in long form: both triangles and the diagonal."""
    half = correlations(df, [(a, b) for i, a in enumerate(cols) for b in cols[i:]])
    sides = F.array(F.struct("left", "right"), F.struct(F.col("right").alias("left"), F.col("left").alias("right")))
    return half.select(F.explode(F.array_distinct(sides)).alias("p"), "correlation").select("p.left", "p.right", "correlation")


def top_correlations(df: DataFrame, target: str, features: Sequence[str], limit: int = 10) -> DataFrame:
    """Features by size of their correlation with the target, with a reading of the sign."""
    found = correlations(df, [(f, target) for f in features]).filter(F.col("correlation").isNotNull())
    sign = F.when(F.col("correlation") > 0, "Moves with target").otherwise("Moves against target")
    order = Window.partitionBy("right").orderBy(F.abs("correlation").desc(), "left")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit)
    return ranked.select(F.col("left").alias("feature"), "correlation", sign.alias("reading"), "rank")


def correlation_summary(df: DataFrame, target: str, features: Sequence[str], limit: int = 10) -> DataFrame:
    """Strongest positive and negative feature, and the strongest pairs overall."""
    cols = [target, *features]
    pairs = correlations(df, [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]])
    pairs = pairs.filter(F.col("correlation").isNotNull())
    of_target = pairs.filter(F.col("left") == target)
    row = F.struct("left", "right", "correlation")
    up = of_target.agg(F.max_by(row, F.struct("correlation", "right")).alias("r")).select(F.lit("target_positive").alias("section"), "r.*")
    down = of_target.agg(F.min_by(row, F.struct("correlation", "right")).alias("r")).select(F.lit("target_negative").alias("section"), "r.*")
    top = pairs.orderBy(F.abs("correlation").desc(), "left", "right").limit(limit)
    return up.unionByName(down).unionByName(top.select(F.lit("pair").alias("section"), "left", "right", "correlation"))


def best_driver(df: DataFrame, target: str, features: Sequence[str], min_rows: int = 3) -> DataFrame:
    """Feature with the largest correlation on rows that have a target."""
    known = df.filter(F.col(target).isNotNull())
    found = correlations(known, [(f, target) for f in features] if known.count() >= min_rows else [])
    best = found.filter("correlation IS NOT NULL").orderBy(F.abs("correlation").desc(), "left").limit(1)
    return best.select(F.col("left").alias("feature"), "correlation")


def theory_checks(df: DataFrame, target: str, features: Sequence[str], theories=rules.THEORY_RULES) -> DataFrame:
    """Expected against observed sign of the first feature whose name fits each rule."""
    chosen = [(name, sign, labels.named_after(list(features), groups)) for name, sign, groups in theories]
    used = sorted({f for _, _, f in chosen if f})
    found = {r["left"]: r["correlation"] for r in correlations(df, [(f, target) for f in used]).collect()} if used else {}
    rows = []
    for name, sign, feature in chosen:
        r = found.get(feature)
        agrees = r is not None and (r > 0 if sign == "Positive" else r < 0)
        verdict = "Missing feature" if feature is None else "Supports theory" if agrees else "Challenges theory"
        rows.append((name, sign, feature or "none", r, verdict))
    schema = "theory string, expected_sign string, feature string, correlation double, evidence string"
    return df.sparkSession.createDataFrame(rows, schema)
