"""Profiling, schema intelligence and data quality."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewright.functions import labels, rules
from tablewright.functions.columns import (
    DATES,
    INTEGERS,
    distinct_values,
    finite,
    is_float,
    numeric_columns,
    one_row,
    other_columns,
    parse_date,
    ratio,
    rows_as_table,
    type_of,
)
from tablewright.operators.correlation import correlations
from tablewright.operators.quantiles import quantile_values, quantiles
from tablewright.operators.selection import cuts


def _missing(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    return (c.isNull() | F.isnan(c)) if is_float(df, name) else c.isNull()


def _total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts) if parts else F.lit(0)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long")


#: Types whose equal values have equal hashes; rows with others are compared whole.
HASHED = (T.NumericType, T.BooleanType, T.BinaryType, *DATES)
#: So many hashes of repeated rows are sent to every task.
FEW_HASHES = 200_000


def repeated_rows(df: DataFrame, few: int = FEW_HASHES) -> int:
    """Rows that repeat an earlier row, exactly: one number on the driver.

    Hashes are counted first, so a row travels as one long.  Only rows whose hash is not alone are compared whole; where
    these are many, all rows are.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]

    def repeats(rows: DataFrame) -> int:
        copies = rows.groupBy(*cols).agg(F.count("*").alias("_copies"))
        return copies.agg(_zero(F.sum(F.col("_copies") - 1)).alias("r")).first()["r"]

    if not cols or not all(isinstance(f.dataType, HASHED) or f.dataType == T.StringType() for f in df.schema):
        return repeats(df)
    hashed = F.xxhash64(*cols)
    again = df.select(hashed.alias("_h")).groupBy("_h").agg(F.count("*").alias("_n")).filter("_n > 1").select("_h").persist()
    try:
        n = again.count()
        if not n:
            return 0
        if n > few:
            return repeats(df)
        return repeats(df.withColumn("_h", hashed).join(F.broadcast(again), "_h", "left_semi").drop("_h"))
    finally:
        again.unpersist()


def dataset_health(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells, repeated rows and empty columns: one pass, and one for repeated rows."""
    cols = df.columns
    gaps = [F.count(F.when(_missing(df, c), 1)) for c in cols]
    filled = [F.max(F.when(_missing(df, c), 0).otherwise(1)) for c in cols]
    empty = _total([F.when(f == 0, 1).otherwise(0) for f in filled])
    return df.agg(
        F.count("*").alias("rows"),
        F.lit(len(cols)).cast("long").alias("columns"),
        _zero(_total(gaps)).alias("missing_cells"),
        F.lit(repeated_rows(df)).cast("long").alias("duplicate_rows"),
        _zero(empty).alias("empty_columns"),
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row."""
    return df.sparkSession.createDataFrame([(repeated_rows(df),)], "duplicate_rows long")


@dataclass(frozen=True)
class TableFacts:
    """Numbers about a whole table that several profiles need: a few for each column."""

    rows: int
    missing: dict[str, int]
    infinite: int
    duplicates: int
    distinct: dict[str, int]


def table_facts(df: DataFrame) -> TableFacts:
    """Counted once for all profiles of a table."""
    cols = df.columns
    wild = [F.count(F.when(F.col(c).isin(float("inf"), float("-inf")), 1)) for c in cols if is_float(df, c)]
    row = one_row(df, F.count("*").alias("n"), _total(wild).alias("wild"), *[F.count(F.when(_missing(df, c), 1)).alias(f"m{i}") for i, c in enumerate(cols)])
    missing = {c: row[f"m{i}"] for i, c in enumerate(cols)}
    return TableFacts(row["n"], missing, row["wild"], repeated_rows(df), distinct_values(df, {c: F.col(f"`{c}`") for c in cols}))


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing count and share per column, most first (``rank``)."""
    cols = df.columns
    wide = df.agg(
        F.count("*").alias("_n"), *[F.count(F.when(_missing(df, c), 1)).alias(f"_m{i}") for i, c in enumerate(cols)]
    )
    cells = [
        (F.lit(c), F.col(f"_m{i}"), F.coalesce(ratio(F.col(f"_m{i}") * 100, F.col("_n")), F.lit(0.0)))
        for i, c in enumerate(cols)
    ]
    return rows_as_table(wide, cells, ["column_name", "missing", "missing_pct"])


def numeric_profile(df: DataFrame, cols: Sequence[str] | None = None, **how) -> DataFrame:
    """count, mean, std, min, quartiles, max per numeric column."""
    cols = list(cols or numeric_columns(df))
    quarts = quantile_values(df, cols, [0.25, 0.5, 0.75], **how)
    wide = df.agg(
        *[
            f(F.col(c).cast("double")).alias(f"{name}_{i}")
            for i, c in enumerate(cols)
            for name, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
        ]
    )
    cells = []
    for i, c in enumerate(cols):
        q = [F.lit(v).cast("double") for v in quarts[c]]
        measured = [F.col(f"{name}_{i}") for name in ("n", "mean", "std", "min")]
        cells.append((F.lit(c), *measured, *q, F.col(f"max_{i}")))
    return rows_as_table(wide, cells, ["metric", "n", "mean", "std", "min", "q25", "q50", "q75", "max"])


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct values per column, exact or by a sketch."""
    found = _distinct(df, {c: F.col(f"`{c}`") for c in (cols or df.columns)}, approximate)
    return df.sparkSession.createDataFrame(list(found.items()), "column_name string, distinct_values long")


def _distinct(df: DataFrame, values: dict[str, Column], approximate: bool) -> dict[str, int]:
    """Numbers of distinct values, exact or by a sketch: one number per column on the driver."""
    if not approximate or not values:
        return distinct_values(df, values)
    row = one_row(df, *[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(values.values())])
    return {name: row[f"d{i}"] for i, name in enumerate(values)}


def data_dictionary(
    df: DataFrame,
    key: Sequence[str],
    date_col: str | None = None,
    target: str | None = None,
    approximate: bool = False,
    known: TableFacts | None = None,
) -> DataFrame:
    """Role, type, gaps, distinct values and a range or three examples per column.

    Examples are the first three filled values by ``key``: every task keeps three rows of a
    column, and no row is copied for it.
    """
    cols = df.columns
    numbers = set(numeric_columns(df))
    distinct = known.distinct if known else _distinct(df, {c: F.col(f"`{c}`") for c in cols}, approximate)
    wide = df.agg(
        F.count("*").alias("_n"),
        *[F.count(F.when(_missing(df, c), 1)).alias(f"_m{i}") for i, c in enumerate(cols)],
        *[f(F.col(c).cast("double")).alias(f"{p}{i}") for i, c in enumerate(cols) if c in numbers for p, f in (("_lo", F.min), ("_hi", F.max))],
    )
    cells = []
    for i, c in enumerate(cols):
        role = "Date" if c == date_col else "Default target" if c == target else "Feature"
        low, high = (F.col(f"_lo{i}"), F.col(f"_hi{i}")) if c in numbers else (F.lit(None), F.lit(None))
        cells.append(
            (
                F.lit(c),
                F.lit(role),
                F.lit(type_of(df, c).simpleString()),
                F.col(f"_m{i}"),
                F.coalesce(ratio(F.col(f"_m{i}") * 100, F.col("_n")), F.lit(0.0)),
                F.lit(distinct[c]).cast("long"),
                low.cast("double"),
                high.cast("double"),
            )
        )
    names = ["column_name", "role", "type", "missing", "missing_pct", "distinct_values", "low", "high"]
    table = rows_as_table(wide, cells, names)
    words = [c for c in cols if c not in numbers]
    if not words:
        return table.withColumn("examples", F.lit(None).cast("string"))
    keys = [f"_k{i}" for i in range(len(key))]
    found = []
    for c in words:
        value = F.col(f"`{c}`")
        filled = df.filter(value.isNotNull()).select(*[F.col(k).alias(k_) for k, k_ in zip(key, keys, strict=True)], value.cast("string").alias("value"))
        first = F.sort_array(F.collect_list(F.struct(*keys, "value")))
        shown = F.concat_ws(", ", F.transform(first, lambda r: r["value"]))
        some = F.when(F.size(first) > 0, shown).alias("examples")
        found.append(filled.orderBy(*keys).limit(3).agg(F.lit(c).alias("column_name"), some))
    examples = reduce(DataFrame.unionAll, found)
    return table.join(examples, "column_name", "left")


def validation_report(df: DataFrame, date_col: str | None = None, target: str | None = None, known: TableFacts | None = None) -> DataFrame:
    """Six checks with Pass, Warning or Fail."""
    cols = df.columns
    if known:
        told = (known.rows, known.duplicates, sum(known.missing.values()), known.infinite)
        facts = df.sparkSession.createDataFrame([told], "n long, dups long, gaps long, wild long")
    else:
        gaps = [F.count(F.when(_missing(df, c), 1)) for c in cols]
        wild = [F.count(F.when(F.col(c).isin(float("inf"), float("-inf")), 1)) for c in cols if is_float(df, c)]
        facts = df.agg(
            F.count("*").alias("n"), F.lit(repeated_rows(df)).cast("long").alias("dups"), _zero(_total(gaps)).alias("gaps"), _zero(_total(wild)).alias("wild")
        )
    share = F.coalesce(ratio(F.col("gaps") * 100, F.col("n") * len(cols)), F.lit(0.0))
    has_date, has_target = date_col in cols, target in cols

    def verdict(good: Column, other: str) -> Column:
        return F.when(good, F.lit("Pass")).otherwise(F.lit(other))

    text = lambda name: F.col(name).cast("string")
    cells = [
        (F.lit("Dataset has rows"), verdict(F.col("n") > 0, "Fail"), text("n")),
        (F.lit("Duplicate rows"), verdict(F.col("dups") == 0, "Warning"), text("dups")),
        (
            F.lit("Overall missing data"),
            F.when(share < 5, "Pass").when(share < 20, "Warning").otherwise("Fail"),
            F.format_string("%.2f%%", share),
        ),
        (F.lit("Date column detected"), F.lit("Pass" if has_date else "Warning"), F.lit(date_col or "not detected")),
        (F.lit("Target detected"), F.lit("Pass" if has_target else "Fail"), F.lit(target or "not detected")),
        (F.lit("Infinite numeric values"), verdict(F.col("wild") == 0, "Fail"), text("wild")),
    ]
    return rows_as_table(facts, cells, ["check_name", "status", "value"])


class QualityGateError(ValueError):
    """A validation check failed."""


def quality_gate(report: DataFrame) -> DataFrame:
    """Pass a validation report through, raising when a check has failed."""
    failed = [r["check_name"] for r in report.filter(F.col("status") == "Fail").collect()]  # at most six rows
    if failed:
        raise QualityGateError("failed checks: " + ", ".join(failed))
    return report


DRIFT_COLUMNS = ["metric", "baseline_mean", "current_mean", "mean_shift_pct", "z_shift", "status"]


def drift_status(z: Column, pct: Column) -> Column:
    return (
        F.when(F.abs(z) >= 1.5, "High drift").when(F.abs(pct) >= 20, "Moderate drift").otherwise("Stable")
    )


def drift_report(df: DataFrame, date_col: str, cols: Sequence[str], tiebreak: Sequence[str] = ()) -> DataFrame:
    """First third of the rows by date against the last third.

    Both thirds are predicates on the sort key, so the data is only aggregated.
    """
    order = [date_col, *tiebreak]
    dated = df.select(*order, *[c for c in cols if c not in order]).filter(F.col(date_col).isNotNull())
    n = dated.count()
    if n < 20:
        return df.sparkSession.createDataFrame([], "metric string, baseline_mean double, current_mean double, mean_shift_pct double, z_shift double, status string")
    size = max(5, n // 3)
    early, middle = cuts(dated, order, [size, n - size])
    late = ~middle
    value = {c: finite(F.col(c).cast("double")) for c in cols}
    wide = dated.agg(
        *[
            out.alias(f"{name}_{i}")
            for i, c in enumerate(cols)
            for name, out in (
                ("b", F.avg(F.when(early, value[c]))),
                ("c", F.avg(F.when(late, value[c]))),
                ("s", F.stddev_samp(F.when(early, value[c]))),
            )
        ]
    )
    cells = []
    for i, c in enumerate(cols):
        base, now, spread = F.col(f"b_{i}"), F.col(f"c_{i}"), F.col(f"s_{i}")
        pct = ratio((now - base) * 100, F.abs(base))
        z = ratio(now - base, spread)
        cells.append((F.lit(c), base, now, pct, z, drift_status(z, pct)))
    return rows_as_table(wide, cells, DRIFT_COLUMNS).filter(
        F.col("baseline_mean").isNotNull() & F.col("current_mean").isNotNull()
    )


#: A number with no more distinct values can be a class.
MOST_CLASSES = 20


def _task_rule(filled: Column, distinct: Column) -> Column:
    """Few distinct numbers mean classes, many mean a measure."""
    room = F.least(F.lit(MOST_CLASSES), F.greatest(F.lit(2), F.floor(filled / 10)))
    return (
        F.when(filled == 0, "Not ready").when(distinct <= room, "Classification").otherwise("Regression")
    )


def infer_task_type(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Suggested task per possible target; unknown names are "Not ready"."""
    known = [t for t in targets if t in df.columns]
    numbers = set(numeric_columns(df))
    wide = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(f"_f{i}") for i, c in enumerate(known)])
    distinct = distinct_values(df, {c: F.col(f"`{c}`") for c in known if c in numbers}, enough=MOST_CLASSES)
    cells = []
    for t in targets:
        if t not in known:
            cells.append((F.lit(t), F.lit("Not ready")))
            continue
        i = known.index(t)
        if t in numbers:
            task = _task_rule(F.col(f"_f{i}"), F.lit(distinct[t]))
        else:
            task = F.when(F.col(f"_f{i}") == 0, "Not ready").otherwise("Classification")
        cells.append((F.lit(t), task))
    return rows_as_table(wide, cells, ["target", "task"])


def _column_facts(df: DataFrame, cols: Sequence[str], approximate: bool) -> dict[str, tuple[int, int, int]]:
    """(rows, filled, distinct) per column: one row on the driver."""
    row = one_row(df, F.count("*").alias("n"), *[F.count(F.when(~_missing(df, c), 1)).alias(f"f{i}") for i, c in enumerate(cols)])
    distinct = _distinct(df, {c: F.col(f"`{c}`") for c in cols}, approximate)
    return {c: (row["n"], row[f"f{i}"], distinct[c]) for i, c in enumerate(cols)}


def _identifier(df: DataFrame, name: str, facts: tuple[int, int, int]) -> bool:
    if labels.says(name, "identifier"):
        return True
    _, filled, distinct = facts
    return isinstance(type_of(df, name), INTEGERS) and filled > 0 and distinct / filled > 0.95


def identifier_columns(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Which columns look like identifiers, by name or by uniqueness of whole numbers."""
    cols = df.columns
    wide = df.agg(*[F.count(F.when(~_missing(df, c), 1)).alias(f"_f{i}") for i, c in enumerate(cols)])
    distinct = _distinct(df, {c: F.col(f"`{c}`") for c in cols}, approximate)
    cells = []
    for i, c in enumerate(cols):
        unique = ratio(F.lit(distinct[c]), F.col(f"_f{i}"))
        whole = isinstance(type_of(df, c), INTEGERS)
        flag = F.lit(True) if labels.says(c, "identifier") else (F.coalesce(unique > 0.95, F.lit(False)) if whole else F.lit(False))
        cells.append((F.lit(c), F.coalesce(unique, F.lit(0.0)), flag.cast("int").cast("long")))
    return rows_as_table(wide, cells, ["column_name", "unique_share", "is_identifier"])


def _as_date(df: DataFrame, name: str) -> Column:
    """The column as a date: dates as they are, text parsed, numbers never."""
    kind = type_of(df, name)
    if isinstance(kind, DATES):
        return F.col(name)
    return parse_date(name) if labels.can_be_date(kind) else F.lit(None).cast("timestamp_ntz")


def date_candidates(df: DataFrame, approximate: bool = False, known: TableFacts | None = None) -> DataFrame:
    """Columns that could be the date, scored by name, parsing and uniqueness."""
    cols = [c for c in df.columns if labels.can_be_date(type_of(df, c)) or labels.date_name_score(c)]
    parsed = {c: _as_date(df, c) for c in cols}
    wide = df.agg(
        F.count("*").alias("_n"),
        *[F.count(parsed[c]).alias(f"_p{i}") for i, c in enumerate(cols)],
    )
    same = {c: known.distinct[c] for c in cols if known and isinstance(type_of(df, c), DATES)}
    distinct = same | _distinct(df, {c: v for c, v in parsed.items() if c not in same}, approximate)
    cells = []
    for i, c in enumerate(cols):
        share = F.coalesce(ratio(F.col(f"_p{i}"), F.col("_n")), F.lit(0.0))
        unique = F.coalesce(ratio(F.lit(distinct[c]), F.col(f"_p{i}")), F.lit(0.0))
        named = labels.date_name_score(c)
        good = share >= 0.5
        reason = (
            F.when(good, "name + parseable dates").otherwise("date-like name") if named else F.lit("parseable dates")
        )
        keep = F.lit(True) if named else good
        cells.append((F.lit(c), F.lit(float(named)) + share * 45 + unique * 10, share * 100, reason, keep))
    table = rows_as_table(wide, cells, ["column_name", "score", "parsed_pct", "reason", "keep"])
    return table.filter("keep").drop("keep")


Facts = dict[str, tuple[int, int, int]]


def _task(filled: int, distinct: int) -> str:
    if not filled:
        return "Not ready"
    return "Classification" if distinct <= min(MOST_CLASSES, max(2, filled // 10)) else "Regression"


def target_candidates(
    df: DataFrame, cols: Sequence[str] | None = None, template: str | None = None, approximate: bool = False, facts: Facts | None = None
) -> DataFrame:
    """Numeric columns scored as a target; constant columns are left out."""
    cols = list(cols or numeric_columns(df))
    facts = facts or _column_facts(df, cols, approximate)
    rows = []
    for c in cols:
        n, filled, distinct = facts[c]
        if distinct <= 1:
            continue
        share = filled / n if n else 0.0
        score = share * 35 + labels.target_name_score(c, template)
        score += 10 if distinct <= min(MOST_CLASSES, max(2, n // 10)) else 18
        score -= 45 if _identifier(df, c, facts[c]) else 0
        rows.append((c, score, (1 - share) * 100, distinct, _task(filled, distinct)))
    return df.sparkSession.createDataFrame(rows, "column_name string, score double, missing_pct double, distinct_values long, task string")


def recommend_features(
    df: DataFrame,
    target: str,
    date_col: str | None = None,
    cols: Sequence[str] | None = None,
    limit: int = 12,
    approximate: bool = False,
    facts: Facts | None = None,
) -> DataFrame:
    """Usable numeric features ranked by the size of their correlation with the target."""
    cols = [c for c in (cols or numeric_columns(df)) if c not in (target, date_col)]
    facts = facts or _column_facts(df, cols, approximate)
    usable = [
        c
        for c in cols
        if facts[c][2] > 1
        and facts[c][1] >= 0.4 * facts[c][0]
        and not _identifier(df, c, facts[c])
        and not labels.follows_target(c, target)
    ]
    pairs = correlations(df, [(c, target) for c in usable]).filter("correlation IS NOT NULL")
    order = Window.partitionBy("right").orderBy(F.abs("correlation").desc(), "left")
    ranked = pairs.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit)
    return ranked.select(F.col("left").alias("feature"), "correlation", "rank")


def leaky_features(df: DataFrame, target: str) -> DataFrame:
    """Name rule per numeric column, with the correlation that shows what leaks."""
    cols = [c for c in numeric_columns(df) if c != target]
    flags = F.create_map(
        *[x for c in cols for x in (F.lit(c), F.lit(int(labels.follows_target(c, target))))]
    )
    pairs = correlations(df, [(c, target) for c in cols])
    return pairs.select(F.col("left").alias("column_name"), flags[F.col("left")].cast("long").alias("leaky"), "correlation")


def smart_setup(
    df: DataFrame, source: str = "", template: str | None = None, approximate: bool = False, known: TableFacts | None = None
) -> DataFrame:
    """Recommended date, target, task and features as (item, value) rows."""
    dates = date_candidates(df, approximate, known).orderBy(F.desc("score"), F.desc("parsed_pct"), "column_name").first()
    if known:
        facts = {c: (known.rows, known.rows - known.missing[c], known.distinct[c]) for c in numeric_columns(df)}
    else:
        facts = _column_facts(df, numeric_columns(df), approximate)
    goals = (
        target_candidates(df, template=template, facts=facts)
        .orderBy(F.desc("score"), F.desc("distinct_values"), "column_name")
        .first()
    )
    date = dates["column_name"] if dates else None
    target = goals["column_name"] if goals else next(iter(numeric_columns(df)), None)
    features: list[str] = []
    if target:
        found = recommend_features(df, target, date, facts=facts).orderBy("rank").collect()  # at most 12
        features = [r["feature"] for r in found]
    wanted = rules.TEMPLATES[template][1] if template else "Auto"
    task = wanted if wanted in ("Regression", "Classification") else (goals["task"] if goals else "Not ready")
    issues = []
    if date is None:
        issues.append("no date column")
    if target is None:
        issues.append("no numeric target")
    if not features:
        issues.append("no clean numeric features")
    rows = [
        ("source", source),
        ("recommended_date", date or "Not detected"),
        ("recommended_target", target or "Not detected"),
        ("suggested_task", task),
        ("numeric_columns", str(len(numeric_columns(df)))),
        ("other_columns", str(len(other_columns(df)))),
        ("recommended_features", ", ".join(features) or "Not available"),
        ("issues", "; ".join(issues) or "none"),
    ]
    return df.sparkSession.createDataFrame(rows, "item string, value string")


def project_profile(
    df: DataFrame, source: str = "", date_col: str | None = None, target: str | None = None, mode: str = "General data", known: TableFacts | None = None
) -> DataFrame:
    """Project facts as (item, value) rows."""
    if known:
        health = {"rows": known.rows, "columns": len(df.columns), "missing_cells": sum(known.missing.values()), "duplicate_rows": known.duplicates}
    else:
        health = one_row(dataset_health(df), *[F.first(c).alias(c) for c in ("rows", "columns", "missing_cells", "duplicate_rows")])
    span = "Not available"
    if date_col:
        ends = one_row(df, F.min(date_col).cast("date").cast("string").alias("a"), F.max(date_col).cast("date").cast("string").alias("b"))
        if ends["a"]:
            span = f"{ends['a']} to {ends['b']}"
    task = infer_task_type(df, [target]).first()["task"] if target else "Not ready"
    rows = [
        ("project_name", labels.project_title(source)),
        ("source", source),
        ("mode", mode),
        ("rows", str(health["rows"])),
        ("columns", str(health["columns"])),
        ("numeric_columns", str(len(numeric_columns(df)))),
        ("other_columns", str(len(other_columns(df)))),
        ("date_column", date_col or "Not selected"),
        ("date_range", span),
        ("target", target or "Not selected"),
        ("task", task),
        ("missing_cells", str(health["missing_cells"])),
        ("duplicate_rows", str(health["duplicate_rows"])),
    ]
    return df.sparkSession.createDataFrame(rows, "item string, value string")


def scale_readiness(df: DataFrame, date_col: str | None = None) -> DataFrame:
    """Size band, date key and number of yearly partitions."""
    years = F.count_distinct(F.year(F.col(date_col))) if date_col else F.lit(0)
    facts = df.agg(F.count("*").alias("n"), years.cast("long").alias("y"))
    cells = [
        (F.lit("Volume"), F.concat(F.col("n").cast("string"), F.lit(f" rows, {len(df.columns)} columns")), labels.size_band(F.col("n"))),
        (F.lit("Variety"), F.lit(f"{len(numeric_columns(df))} numeric measures"), F.lit("Structured data")),
        (
            F.lit("Time partitioning"),
            F.concat(F.col("y").cast("string"), F.lit(" years")),
            F.lit("Ready" if date_col in df.columns else "Needs date key"),
        ),
    ]
    return rows_as_table(facts, cells, ["dimension", "evidence", "readiness"])


def stage_status(df: DataFrame, date_col: str | None = None, target: str | None = None, evaluated: bool = False) -> DataFrame:
    """Where the work on a table stands, stage by stage."""
    facts = df.agg(F.count("*").alias("n"))
    cells = [
        (F.lit("Raw data"), F.when(F.col("n") > 0, "Complete").otherwise("Needs data"), F.col("n").cast("string")),
        (F.lit("Cleaning"), F.lit("Complete"), F.lit(date_col or "not detected")),
        (F.lit("Feature selection"), F.lit("Complete" if target else "Needs target"), F.lit(target or "not detected")),
        (F.lit("Model training"), F.lit("Complete" if evaluated else "Run Evaluation"), F.lit("Comparison table" if evaluated else "No run yet")),
        (F.lit("Evaluation"), F.lit("Complete" if evaluated else "Run Evaluation"), F.lit("Metrics" if evaluated else "No metrics yet")),
        (F.lit("Reporting"), F.lit("Complete"), F.lit("Report facts")),
    ]
    return rows_as_table(facts, cells, ["stage", "status", "output"])


def catalog_search(
    df: DataFrame,
    query: str,
    title: str,
    keywords: str,
    description: str,
    key: str,
    limit: int = 5,
    fuzzy: float = 0.78,
) -> DataFrame:
    """Rank the entries of a catalog table for a text query; top ``limit`` with a rank.

    Per word the best place counts (title, keywords, description, similar word); the
    whole phrase earns extra.  Word similarity is 1 - levenshtein / longer length.
    """
    text = query.strip().lower()
    words = [w for w in text.split() if w]
    t, k, d = (F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in (title, keywords, description))
    everything = F.concat_ws(" ", t, k, d)
    score = F.when(t.contains(text), 8.0).otherwise(0.0) + F.when(everything.contains(text), 4.0).otherwise(0.0)
    pieces = F.filter(F.split(F.translate(everything, "&/", "  "), r"\s+"), lambda w: w != "")

    def similar(word: str) -> Column:
        def close(piece: Column) -> Column:
            longer = F.greatest(F.length(piece), F.lit(len(word)))
            return 1.0 - F.levenshtein(piece, F.lit(word)) / longer >= fuzzy

        return F.exists(pieces, close)

    for word in words:
        place = F.when(t.contains(word), 5.0).when(k.contains(word), 3.0).when(d.contains(word), 2.0)
        score = score + place.when(similar(word), 1.5).otherwise(0.0)
    hits = df.select(F.col(key), F.col(title), score.alias("score")).filter(F.col("score") > 0)
    return hits.orderBy(F.desc("score"), F.col(key)).limit(limit)


def box_stats(df: DataFrame, value: str, by: Sequence[str], factor: float = 1.5, **how) -> DataFrame:
    """Quartiles, fences, whiskers and number of outlier points per group."""
    q = quantiles(df, [value], [0.25, 0.5, 0.75], by=by, **how)
    edges = q.select(*by, *[F.col("q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))])
    spread = (F.col("q75") - F.col("q25")) * factor
    edges = edges.withColumn("low_fence", F.col("q25") - spread).withColumn("high_fence", F.col("q75") + spread)
    # The value counts carry everything the second pass needs, and hot values collapse in them.
    counted = df.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c")).filter("_v IS NOT NULL")
    on = reduce(lambda a, b: a & b, [F.col(f"c.{b}").eqNullSafe(F.col(f"e.{b}")) for b in by])
    inside = F.col("_v").between(F.col("low_fence"), F.col("high_fence"))
    joined = counted.alias("c").join(edges.alias("e"), on)
    keep = ["q25", "q50", "q75", "low_fence", "high_fence"]
    return joined.groupBy(*[F.col(f"e.{b}") for b in by], *keep).agg(
        F.sum("_c").alias("n"),
        F.min(F.when(inside, F.col("_v"))).alias("low_whisker"),
        F.max(F.when(inside, F.col("_v"))).alias("high_whisker"),
        F.sum(F.when(inside, 0).otherwise(F.col("_c"))).alias("outliers"),
    )


def box_points(df: DataFrame, value: str, by: Sequence[str], factor: float = 1.5, **how) -> DataFrame:
    """Every row outside its group's fences, with the fence it passes; rows without a value are none."""
    q = quantiles(df.filter(F.col(value).isNotNull()), [value], [0.25, 0.75], by=by, **how)
    low, high = F.col("q")[0], F.col("q")[1]
    spread = (high - low) * factor
    edges = q.select(*by, (low - spread).alias("low_fence"), (high + spread).alias("high_fence"))
    on = reduce(lambda a, b: a & b, [F.col(f"d.{b}").eqNullSafe(F.col(f"e.{b}")) for b in by])
    v = F.col(f"d.{value}").cast("double")
    side = F.when(v < F.col("e.low_fence"), "low").when(v > F.col("e.high_fence"), "high")
    return df.alias("d").join(edges.alias("e"), on).select("d.*", side.alias("side")).filter("side IS NOT NULL")


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over the whole range; the maximum falls into the last bin."""
    ends = one_row(df, F.min(F.col(value).cast("double")).alias("lo"), F.max(F.col(value).cast("double")).alias("hi"))
    lo, hi = ends["lo"], ends["hi"]
    v = F.col(value).cast("double")
    if lo is None or lo == hi:
        bucket, width = F.when(v.isNotNull(), F.lit(1)), 0.0
    else:
        width = (hi - lo) / bins
        bucket = F.least(F.floor((v - F.lit(lo)) / F.lit(width)) + 1, F.lit(bins))
    counted = df.filter(v.isNotNull()).groupBy(*by, bucket.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    start = F.lit(lo) + (F.col("bin") - 1) * F.lit(width)
    return counted.withColumn("bin_start", start.cast("double"))
