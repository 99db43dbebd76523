"""Report facts as (section, item, value) rows, ready for any report writer."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import labels
from tablewright.functions.columns import numeric_columns, one_row, rows_as_table
from tablewright.operators import correlation, metrics, profile

SCHEMA = "section string, item string, value string"


def number(c: Column, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}f", c.cast("double"))


def as_facts(df: DataFrame, section: str, item: str, value: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.col(item).cast("string").alias("item"), value.cast("string").alias("value"))


def _overview(df: DataFrame, date_col: str | None, section: str) -> DataFrame:
    day = lambda f: F.date_format(f(date_col), "yyyy-MM-dd")
    span = F.concat(day(F.min), F.lit(" to "), day(F.max)) if date_col else F.lit(None)
    facts = df.agg(F.count("*").alias("n"), span.cast("string").alias("span"))
    cells = [
        (F.lit(section), F.lit("rows"), F.col("n").cast("string")),
        (F.lit(section), F.lit("columns"), F.lit(str(len(df.columns)))),
        (F.lit(section), F.lit("date_range"), F.coalesce("span", F.lit("not available"))),
    ]
    return rows_as_table(facts, cells, ["section", "item", "value"])


def _signal(df: DataFrame, target: str, section: str) -> DataFrame:
    features = [c for c in numeric_columns(df) if c != target and not labels.follows_target(c, target)]
    best = correlation.best_driver(df, target, features) if features else None
    text = "not available"
    row = best.first() if best is not None else None
    if row:
        text = f"{row['feature']} (corr={row['correlation']:.2f})"
    return df.sparkSession.createDataFrame([(section, "strongest_signal", text)], SCHEMA)


def _best(evaluation: DataFrame | None, metric: str, section: str, spark) -> DataFrame:
    row = metrics.best_by(evaluation, metric).first() if evaluation is not None else None
    text = f"{row['model']} ({metric}={row[metric]:.3f})" if row else "not evaluated"
    return spark.createDataFrame([(section, "best_model", text)], SCHEMA)


def executive_facts(df: DataFrame, date_col: str | None, target: str, evaluation: DataFrame | None = None, metric: str = "r2") -> DataFrame:
    """Size, dates, target, strongest signal and best model."""
    spark = df.sparkSession
    parts = [
        _overview(df, date_col, "dataset"),
        spark.createDataFrame([("dataset", "target", target)], SCHEMA),
        _signal(df, target, "findings"),
        _best(evaluation, metric, "findings", spark),
    ]
    return reduce(DataFrame.unionByName, parts)


def report_facts(
    df: DataFrame,
    source: str,
    key: list[str],
    date_col: str | None,
    target: str,
    audit: DataFrame | None = None,
    evaluation: DataFrame | None = None,
    template: str | None = None,
    metric: str = "r2",
) -> DataFrame:
    """Every section of the full report in one table."""
    spark = df.sparkSession
    aside = inheritable_thread_target(spark)
    with ThreadPoolExecutor(3) as pool:  # sections that need nothing of each other share the cores
        summarised = pool.submit(aside(lambda: profile.numeric_profile(df)))
        signalled = pool.submit(aside(lambda: _signal(df, target, "findings")))
        scored = pool.submit(aside(lambda: None if evaluation is None else evaluation.collect()))  # one row per model, used twice
        known = profile.table_facts(df)
        sections = [
            as_facts(profile.project_profile(df, source, date_col, target, known=known), "project", "item", F.col("value")),
            as_facts(profile.smart_setup(df, source, template, known=known), "setup", "item", F.col("value")),
            as_facts(profile.validation_report(df, date_col, target, known=known), "validation", "check_name", F.concat_ws(" ", "status", "value")),
        ]
        dictionary = profile.data_dictionary(df, key, date_col, target, known=known)
        summary, signal, scores = summarised.result(), signalled.result(), scored.result()
    if evaluation is not None:
        evaluation = spark.createDataFrame(scores, evaluation.schema)
    measured = [F.concat(F.lit(f"{n}="), number(F.col(n))) for n in ("n", "mean", "std", "min", "q25", "q50", "q75", "max")]
    parts = [
        *sections,
        as_facts(summary, "numeric_summary", "metric", F.concat_ws(" ", *measured)),
        as_facts(dictionary, "dictionary", "column_name", F.concat_ws(" ", "role", "type", F.col("distinct_values").cast("string"))),
        signal,
        _best(evaluation, metric, "findings", spark),
    ]
    if audit is not None:
        parts.append(as_facts(audit, "audit", "action", F.concat_ws(" ", F.col("cells_changed").cast("string"), F.col("rows_changed").cast("string"))))
    if evaluation is not None:
        parts.append(as_facts(evaluation, "evaluation", "model", number(F.col(metric))))
    return reduce(DataFrame.unionByName, parts)


def model_card_facts(evaluation: DataFrame, metric: str, validation: DataFrame, drift: DataFrame, target: str) -> DataFrame:
    """Best model, its score, failed checks and drifting features."""
    spark = evaluation.sparkSession
    failed = validation.agg(F.count(F.when(F.col("status") == "Fail", 1)).alias("n")).select(
        F.lit("validation").alias("section"), F.lit("failed_checks").alias("item"), F.col("n").cast("string").alias("value")
    )
    moved = drift.agg(F.count(F.when(F.col("status") != "Stable", 1)).alias("n")).select(
        F.lit("drift").alias("section"), F.lit("drifting_features").alias("item"), F.col("n").cast("string").alias("value")
    )
    parts = [spark.createDataFrame([("model", "target", target)], SCHEMA), _best(evaluation, metric, "model", spark), failed, moved]
    return reduce(DataFrame.unionByName, parts)


def conclusion_facts(theory: DataFrame, verdicts: DataFrame, driver: DataFrame) -> DataFrame:
    """Theory checks and periods counted by outcome, and the best driver."""
    counted = theory.agg(
        F.count(F.when(F.col("evidence") == "Supports theory", 1)).alias("s"), F.count(F.when(F.col("evidence") == "Challenges theory", 1)).alias("c")
    )
    periods = verdicts.agg(
        F.count(F.when(F.col("verdict") == "Matches real-life expectation", 1)).alias("m"),
        F.count(F.when(F.col("verdict") == "Consistent with mixed real-world forces", 1)).alias("x"),
    )
    text = lambda c: F.col(c).cast("string")
    names = ["section", "item", "value"]
    parts = [
        rows_as_table(counted, [(F.lit("theory"), F.lit("supported"), text("s")), (F.lit("theory"), F.lit("challenged"), text("c"))], names),
        rows_as_table(periods, [(F.lit("periods"), F.lit("matched"), text("m")), (F.lit("periods"), F.lit("mixed"), text("x"))], names),
        driver.select(F.lit("driver").alias("section"), F.col("feature").alias("item"), number(F.col("correlation"), 2).alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts)


def impact_facts(evaluation: DataFrame | None, metric: str, change: DataFrame) -> DataFrame:
    """Champion and the sign of the latest movement; ``change`` holds at most one row."""
    spark = change.sparkSession
    row = change.first()
    moved = None if row is None else row["latest_change"]
    if moved is None:
        told = ("impact", "movement", "not available")
    else:
        sign = "positive" if moved > 0 else "negative" if moved < 0 else "flat"
        told = ("impact", "movement", f"{sign} {moved:.2f}")
    return _best(evaluation, metric, "impact", spark).unionByName(spark.createDataFrame([told], SCHEMA))


def evaluation_gap(evaluation: DataFrame, metric: str) -> DataFrame:
    """Best and weakest model and the distance between them."""
    pair = F.struct("model", F.col(metric).alias("v"))
    known = evaluation.filter(F.col(metric).isNotNull())
    ends = known.agg(
        F.min_by(pair, F.struct((-F.col(metric)).alias("a"), "model")).alias("b"), F.min_by(pair, F.struct(F.col(metric), "model")).alias("w")
    )
    return ends.select(
        F.col("b.model").alias("best_model"), F.col("b.v").alias("best_score"), F.col("w.model").alias("weakest_model"),
        F.col("w.v").alias("weakest_score"), (F.col("b.v") - F.col("w.v")).alias("gap"),
    )


def context_summary(df: DataFrame, date_col: str | None, target: str, gaps: int = 5) -> DataFrame:
    """Size, dates and the columns with the most gaps."""
    facts = one_row(profile.dataset_health(df), *[F.first(c).alias(c) for c in ("missing_cells", "duplicate_rows")])
    spark = df.sparkSession
    rows = [("context", "target", target), ("context", "missing_cells", str(facts["missing_cells"])), ("context", "duplicate_rows", str(facts["duplicate_rows"]))]
    most = profile.missing_profile(df).orderBy(F.desc("missing"), "column_name").limit(gaps)
    return _overview(df, date_col, "context").unionByName(spark.createDataFrame(rows, SCHEMA)).unionByName(
        as_facts(most, "most_missing", "column_name", F.col("missing"))
    )
