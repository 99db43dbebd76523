"""Cleaning and repair.  Statistics become literals, the repair itself is a projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions import labels, rules
from tablewright.functions.columns import (
    filled,
    finite,
    is_float,
    numeric_columns,
    one_row,
    other_columns,
    parse_date,
    parse_number,
    text_long,
    type_of,
)
from tablewright.operators.correlation import correlations
from tablewright.operators.ordinal import running
from tablewright.operators.profile import dataset_health
from tablewright.operators.quantiles import quantile_values
from tablewright.session import work_dir

CUT_EVERY = 4  # repaired columns between two checkpoints


def trim_columns(df: DataFrame) -> DataFrame:
    names = [c.strip() for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"column names collide after trimming: {', '.join(twice)}")
    return df.toDF(*names)


def parse_date_column(df: DataFrame, name: str) -> DataFrame:
    """Text to timestamp in place; what does not parse becomes NULL."""
    return df.withColumn(name, parse_date(name))


def coerce_numeric(df: DataFrame, keep: Sequence[str] = (), min_ratio: float = 0.0) -> DataFrame:
    """Make a column numeric when at least one value (or ``min_ratio`` of them) parses."""
    texts = [c for c in other_columns(df) if c not in keep and type_of(df, c).simpleString() in ("string", "boolean")]
    if not texts:
        return df
    value = {c: F.col(c).cast("double") if type_of(df, c).simpleString() == "boolean" else parse_number(c) for c in texts}
    row = one_row(
        df,
        *[F.count(value[c]).alias(f"p{i}") for i, c in enumerate(texts)],
        *[F.count(c).alias(f"f{i}") for i, c in enumerate(texts)],
    )
    change = {
        c: value[c] for i, c in enumerate(texts) if row[f"p{i}"] > 0 and row[f"p{i}"] >= min_ratio * row[f"f{i}"]
    }
    return df.withColumns(change) if change else df


def clean_table(df: DataFrame, periods=rules.PERIODS, period_name: str = "time_group") -> tuple[DataFrame, str | None]:
    """Trim names, parse the date, coerce numbers, drop NaN, label the period."""
    out = trim_columns(df)
    date = labels.find_date_col(out.columns)
    if date and type_of(out, date).simpleString() not in ("timestamp_ntz", "timestamp", "date"):
        out = parse_date_column(out, date)
    out = coerce_numeric(out, keep=[date] if date else [])
    if date:
        return out.withColumn(period_name, labels.period_label(F.col(date), periods)), date
    return out.withColumn(period_name, F.lit(rules.UNKNOWN_PERIOD)), None


def add_period(df: DataFrame, date_col: str, periods=rules.PERIODS, name: str = "time_group") -> DataFrame:
    return df.withColumn(name, labels.period_label(F.col(date_col), periods))


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*[n for n in names if n in df.columns])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns without a single value; an empty table keeps its columns."""
    row = one_row(df, F.count("*").alias("n"), *[F.count(filled(df, c)).alias(f"f{i}") for i, c in enumerate(df.columns)])
    if not row["n"]:
        return df
    return df.drop(*[c for i, c in enumerate(df.columns) if row[f"f{i}"] == 0])


def drop_duplicates(df: DataFrame, subset: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Exact duplicates, or the first row by ``order`` per value of ``subset``.

    The first row per key is a ``min_by`` aggregate, so copies collapse before the shuffle.
    """
    if not subset:
        return df.dropDuplicates()
    row = F.struct(*df.columns)
    first = df.groupBy(*[F.col(s).alias(f"_g{i}") for i, s in enumerate(subset)]).agg(F.min_by(row, F.struct(*(order or df.columns))).alias("r"))
    return first.select("r.*")


def fill_numeric(df: DataFrame, cols: Sequence[str], strategy: str = "median", **how) -> DataFrame:
    """NULL to mean or median; a column without values stays as it is."""
    if strategy == "median":
        stats = {c: v[0] for c, v in quantile_values(df, cols, [0.5], **how).items()}
    else:
        row = one_row(df, *[F.avg(finite(c) if is_float(df, c) else F.col(c)).alias(c) for c in cols])
        stats = {c: row[c] for c in cols}
    fills = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in stats.items() if v is not None}
    return df.withColumns(fills) if fills else df


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Most frequent value per column as text; the smaller value wins a tie."""
    counted = text_long(df, [], cols).filter("value IS NOT NULL").groupBy("column_name", "value").agg(F.count("*").alias("hits"))
    best = F.min_by("value", F.struct((-F.col("hits")).alias("h"), F.col("value")))
    return counted.groupBy("column_name").agg(best.alias("mode"), F.max("hits").alias("hits"))


def fill_mode(df: DataFrame, cols: Sequence[str], otherwise: str = rules.UNKNOWN_PERIOD) -> DataFrame:
    """NULL to the most frequent value; text columns without values get ``otherwise``."""
    found = {r["column_name"]: r["mode"] for r in modes(df, cols).collect()}  # one row per column
    fills = {}
    for c in cols:
        value = found.get(c)
        if value is None and type_of(df, c).simpleString() != "string":
            continue
        fills[c] = F.coalesce(F.col(c), F.lit(value if value is not None else otherwise).cast(type_of(df, c)))
    return df.withColumns(fills) if fills else df


@dataclass(frozen=True)
class Fence:
    low: float
    high: float


def iqr_fences(df: DataFrame, cols: Sequence[str], factor: float = 1.5, **how) -> dict[str, Fence | None]:
    """Quartile fences as literals; None where the spread is missing or zero."""
    out: dict[str, Fence | None] = {}
    for c, (q1, q3) in quantile_values(df, cols, [0.25, 0.75], **how).items():
        spread = None if q1 is None else q3 - q1
        out[c] = Fence(q1 - factor * spread, q3 + factor * spread) if spread else None
    return out


def outlier(name: str, fence: Fence | None) -> Column:
    """True outside the fence; a missing value is no outlier."""
    if fence is None:
        return F.lit(False)
    return F.coalesce((F.col(name) < F.lit(fence.low)) | (F.col(name) > F.lit(fence.high)), F.lit(False))


def iqr_flags(df: DataFrame, cols: Sequence[str], factor: float = 1.5, **how) -> DataFrame:
    fences = iqr_fences(df, cols, factor, **how)
    return df.withColumns({f"{c}_outlier": outlier(c, fences[c]) for c in cols})


def remove_iqr_outliers(df: DataFrame, cols: Sequence[str], factor: float = 1.5, **how) -> DataFrame:
    out = df
    for c, fence in iqr_fences(df, cols, factor, **how).items():
        if fence:
            out = out.filter(F.col(c).between(fence.low, fence.high) | F.col(c).isNull())
    return out


def cap_iqr_outliers(df: DataFrame, cols: Sequence[str], factor: float = 1.5, **how) -> DataFrame:
    change = {}
    for c, fence in iqr_fences(df, cols, factor, **how).items():
        if fence:
            low, high = F.lit(fence.low), F.lit(fence.high)
            change[c] = F.when(F.col(c) < low, low).when(F.col(c) > high, high).otherwise(F.col(c))
    return df.withColumns(change) if change else df


def replace_outliers(df: DataFrame, cols: Sequence[str], strategy: str = "median", factor: float = 1.5, **how) -> DataFrame:
    """Flagged values become the mean or median of the unflagged ones."""
    fences = iqr_fences(df, cols, factor, **how)
    clean = df.select(*[F.when(~outlier(c, fences[c]), F.col(c)).alias(c) for c in cols])
    if strategy == "median":
        stats = {c: v[0] for c, v in quantile_values(clean, cols, [0.5], **how).items()}
    else:
        row = one_row(clean, *[F.avg(c).alias(c) for c in cols])
        stats = {c: row[c] for c in cols}
    change = {
        c: F.when(outlier(c, fences[c]), F.lit(float(stats[c]))).otherwise(F.col(c))
        for c in cols
        if fences[c] and stats[c] is not None
    }
    return df.withColumns(change) if change else df


def _least_squares(df: DataFrame, y: str, xs: Sequence[Column], ready: Column) -> tuple[list[float], float]:
    """Ordinary least squares from one pass of centred cross products."""
    rows = df.filter(ready).select(F.col(y).cast("double").alias("y"), *[x.alias(f"x{i}") for i, x in enumerate(xs)])
    names = [f"x{i}" for i in range(len(xs))]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = one_row(
        rows,
        *[F.avg(n).alias(f"m_{n}") for n in [*names, "y"]],
        *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs],
        *[F.covar_pop(n, "y").alias(f"c_{n}_y") for n in names],
    )
    size = len(names)
    gram = np.zeros((size, size))
    for i, a in enumerate(names):
        for j, b in enumerate(names[i:], start=i):
            gram[i, j] = gram[j, i] = row[f"c_{a}_{b}"]
    right = np.array([row[f"c_{n}_y"] for n in names])
    weights = np.linalg.lstsq(gram, right, rcond=1e-12)[0]
    intercept = row["m_y"] - float(np.dot(weights, [row[f"m_{n}"] for n in names]))
    return [float(w) for w in weights], intercept


def fill_from_correlated(
    df: DataFrame,
    cols: Sequence[str],
    flags: dict[str, Column] | None = None,
    max_features: int = 5,
    snapshot: bool = False,
    **how,
) -> tuple[DataFrame, DataFrame]:
    """Estimate missing (or flagged) values by regression on the most correlated columns.

    Columns are repaired in order and later ones see the earlier repairs; ``snapshot``
    ranks the correlations on the input only.  Returns the table and a report.
    """
    work_dir(df.sparkSession)
    numbers = numeric_columns(df)
    flag_names = {}
    out = df
    for c, flag in (flags or {}).items():
        flag_names[c] = f"_flag_{c}"
        out = out.withColumn(flag_names[c], flag)
    report = []
    repaired = 0
    for c in cols:
        if c not in numbers:
            continue
        broken = F.col(flag_names[c]) if c in flag_names else F.col(c).isNull()
        usable = ~broken & F.col(c).isNotNull()
        facts = one_row(out, F.count(F.when(broken, 1)).alias("broken"), F.count(F.when(usable, 1)).alias("usable"))
        if not facts["broken"]:
            continue
        others = [n for n in numbers if n != c]
        ranked = []
        if others:
            found = correlations(df if snapshot else out, [(n, c) for n in others]).filter("correlation IS NOT NULL")
            best = found.orderBy(F.abs("correlation").desc(), "left").limit(max_features).collect()
            ranked = [r["left"] for r in best]
        middle = quantile_values(out.select(F.when(usable, F.col(c)).alias(c)), [c], [0.5], **how)[c][0]
        if middle is None:
            middle = quantile_values(out, [c], [0.5], **how)[c][0]
        estimate, method = None, "Fallback median"
        if ranked and facts["usable"] >= max(8, len(ranked) + 2):
            medians = quantile_values(out.filter(usable), ranked, [0.5], **how)
            xs = [F.coalesce(F.col(n).cast("double"), F.lit(medians[n][0] or 0.0)) for n in ranked]
            weights, intercept = _least_squares(out, c, xs, usable)
            estimate = F.lit(intercept)
            for w, x in zip(weights, xs, strict=True):
                estimate = estimate + F.lit(w) * x
            estimate, method = F.coalesce(finite(estimate), F.lit(middle).cast("double")), "Correlation estimate"
        elif middle is not None:
            estimate = F.lit(float(middle))
        if estimate is not None:
            out = out.withColumn(c, F.when(broken, estimate).otherwise(F.col(c).cast("double")))
            repaired += 1
            if repaired % CUT_EVERY == 0:
                out = out.checkpoint()
        report.append((c, facts["broken"], method, ", ".join(ranked) or "None available"))
    schema = "column_name string, filled long, method string, features string"
    return out.drop(*flag_names.values()), df.sparkSession.createDataFrame(report, schema)


def estimate_outliers(df: DataFrame, cols: Sequence[str], factor: float = 1.5, **how) -> tuple[DataFrame, DataFrame]:
    """Replace out-of-fence values by their regression estimate."""
    fences = iqr_fences(df, cols, factor, **how)
    return fill_from_correlated(df, cols, flags={c: outlier(c, fences[c]) for c in cols}, **how)


def forward_fill(df: DataFrame, cols: Sequence[str], keys: Sequence[str], order: Sequence[str], grain: str | None = None, **how) -> DataFrame:
    """Carry the last value of a series forward."""
    made = running(df, keys, order, lasts={f"_f_{c}": c for c in cols}, grain=grain, **how)
    return made.withColumns({c: F.col(f"_f_{c}") for c in cols}).drop(*[f"_f_{c}" for c in cols])


def inf_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    floats = [c for c in (cols or df.columns) if is_float(df, c)]
    return df.withColumns({c: finite(c) for c in floats}) if floats else df


def cleaning_report(raw: DataFrame, cleaned: DataFrame, date_col: str | None) -> DataFrame:
    """Seven audit rows over the table before and after the automatic cleaning."""
    before, after = dataset_health(raw).first(), dataset_health(cleaned).first()  # one row each
    trimmed = sum(c != c.strip() for c in raw.columns)
    good, bad = "Checked - already clean", "Needs attention"
    rows = [
        ("Column names", str(trimmed), "Applied" if trimmed else good),
        ("Date parsing", date_col or "none", "Applied" if date_col else "Checked - not available"),
        ("Numeric conversion", str(len(numeric_columns(cleaned))), "Applied"),
        ("Missing values", f"{before['missing_cells']} -> {after['missing_cells']}", bad if after["missing_cells"] else good),
        ("Duplicate rows", str(after["duplicate_rows"]), bad if after["duplicate_rows"] else good),
        ("Period label", "time_group", "Applied"),
        ("Row count", f"{before['rows']} -> {after['rows']}", good if before["rows"] == after["rows"] else "Applied"),
    ]
    return raw.sparkSession.createDataFrame(rows, "step string, result string, status string")


@dataclass
class StudioPlan:
    """Actions of the cleaning studio; the defaults change nothing."""

    drop: Sequence[str] = ()
    drop_empty: bool = False
    drop_repeats: bool = False
    numeric_columns: Sequence[str] = ()
    numeric_fill: str | None = None  # mean, median or estimate
    fill_text: bool = False
    outlier_columns: Sequence[str] = ()
    outliers: str | None = None  # remove, cap, mean, median or estimate
    factor: float = 1.5
    how: dict = field(default_factory=dict)


def _gaps(df: DataFrame, cols: Sequence[str]) -> int:
    """Missing cells over ``cols``."""
    if not cols:
        return 0
    row = one_row(df, F.count("*").alias("n"), *[F.count(filled(df, c)).alias(f"f{i}") for i, c in enumerate(cols)])
    return sum(row["n"] - row[f"f{i}"] for i in range(len(cols)))


def cleaning_studio(df: DataFrame, plan: StudioPlan) -> tuple[DataFrame, DataFrame]:
    """Run the chosen actions in their fixed order; return the table and an audit."""
    audit: list[tuple[str, int, int, int]] = []  # action, cells changed, rows changed, columns changed
    out = df

    def note(action: str, cells: int = 0, rows: int = 0, columns: int = 0) -> None:
        audit.append((action, int(cells), int(rows), int(columns)))

    def narrowed(action: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        changed = change(out)
        note(action, columns=len(changed.columns) - len(out.columns))
        return changed

    if plan.drop:
        out = narrowed("Drop selected columns", lambda d: drop_columns(d, plan.drop))
    if plan.drop_empty:
        out = narrowed("Drop empty columns", drop_empty_columns)
    if plan.drop_repeats:
        before = out.count()
        work_dir(df.sparkSession)
        out = drop_duplicates(out).checkpoint()  # the later actions read it several times
        note("Remove duplicate rows", rows=out.count() - before)
    targets = [c for c in plan.numeric_columns if c in numeric_columns(out)]
    if plan.numeric_fill and targets:
        before = _gaps(out, targets)
        if plan.numeric_fill == "estimate":
            out, _ = fill_from_correlated(out, targets, **plan.how)
        else:
            out = fill_numeric(out, targets, plan.numeric_fill, **plan.how)
        note("Repair numeric missing values", cells=before - _gaps(out, targets))
    if plan.fill_text:
        texts = other_columns(out)
        before = _gaps(out, texts)
        out = fill_mode(out, texts)
        note("Fill categorical missing values", cells=before - _gaps(out, texts))
    watched = [c for c in plan.outlier_columns if c in numeric_columns(out)]
    if plan.outliers and watched:
        fences = iqr_fences(out, watched, plan.factor, **plan.how)
        row = one_row(out, F.count("*").alias("n"), *[F.count(F.when(outlier(c, fences[c]), 1)).alias(f"o{i}") for i, c in enumerate(watched)])
        cells = sum(row[f"o{i}"] for i in range(len(watched)))
        lost = 0
        if plan.outliers == "remove":
            out = remove_iqr_outliers(out, watched, plan.factor, **plan.how)
            lost = out.count() - row["n"]
        elif plan.outliers == "cap":
            out = cap_iqr_outliers(out, watched, plan.factor, **plan.how)
        elif plan.outliers == "estimate":
            out, _ = estimate_outliers(out, watched, plan.factor, **plan.how)
        else:
            out = replace_outliers(out, watched, plan.outliers, plan.factor, **plan.how)
        note("Repair numeric outliers", cells=cells, rows=lost)
    if not audit:
        note("No action selected")
    schema = "action string, cells_changed long, rows_changed long, columns_changed long"
    return out, df.sparkSession.createDataFrame(audit, schema)
