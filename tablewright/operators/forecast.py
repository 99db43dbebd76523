"""Forecasts for one or many monthly series.

Series are bounded by the calendar (one row per key and month), so keyed windows and
per-series arrays are safe; a table without a key is treated as one series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions import rules
from tablewright.operators.cleaning import forward_fill
from tablewright.operators.models import Fitted, fit_model
from tablewright.operators.series import (
    BLEND,
    event_features,
    future_calendar,
    horizon_bounds,
    horizon_rows,
    lag_features,
    project_features,
    regime_weights,
)
from tablewright.session import work_dir

SERIES, ROW = "_series", "_row"
HORIZON_TERMS = ["horizon", "horizon_sqrt", "horizon_sq"]


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn(SERIES, F.lit("all")), [SERIES])


def direct_forecast(
    df: DataFrame,
    date_col: str,
    target: str,
    features: Sequence[str],
    horizon: int,
    keys: Sequence[str] = (),
    model: str = "Ridge",
    params: dict | None = None,
    mode: str = BLEND,
    windows=rules.EVENT_WINDOWS,
    start: str = rules.EVENT_START,
    grain: str = "month",
) -> DataFrame:
    """Forecast every horizon from the last known row of each series.

    One model learns the change over 1..H steps from all rows of all series, newer rows
    weigh more and far horizons less; predictions stay within the changes seen before.
    Every series comes back with every horizon; one that is too short to be forecast has a
    NULL forecast and a ``reason``.
    """
    table, by = _keyed(df.select(*keys, date_col, target, *features), keys)
    base = forward_fill(table, features, by, [date_col], grain) if features else table
    base, events = event_features(base, date_col, windows, start)
    base = base.persist()
    inputs = [*features, *events]
    lagged = lag_features(base, target, inputs, [date_col], by, grain=grain).filter(F.col(target).isNotNull())
    columns = [c for c in lagged.columns if c not in (*by, date_col, target)]
    complete = lagged.dropna("any", subset=columns).persist()
    own = [c for c in columns if c not in inputs]
    pairs = horizon_rows(complete, date_col, target, inputs, horizon, by, grain, keep=columns)
    future = [f"{f}_future_change" for f in inputs]
    used = [*inputs, *own, *HORIZON_TERMS, *future]
    pairs = pairs.persist()  # the fit reads it several times
    weighted = regime_weights(pairs, date_col, start, name="_w").withColumn("_w", F.col("_w") / F.sqrt("horizon"))
    fitted = fit_model(weighted, "cumulative_change", used, model, params=params, weight="_w", key=None)

    ahead = future_calendar(base, date_col, horizon, by, date_col)
    for f in features:
        ahead = ahead.join(project_features(base, date_col, f, horizon, mode, by), [*by, "horizon"], "left")
    ahead, _ = event_features(ahead, date_col, windows, start)
    last = F.max_by(F.struct(*columns), F.col(date_col))
    origin = complete.groupBy(*by).agg(last.alias("_o"))
    level = base.groupBy(*by).agg(
        F.max_by(target, F.when(F.col(target).isNotNull(), F.col(date_col))).cast("double").alias("_level"),
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(date_col))).alias(f"_now_{f}") for f in inputs],
    )
    changes = [(F.col(f) - F.col(f"_now_{f}")).cast("double").alias(f"{f}_future_change") for f in inputs]
    placed = ahead.join(origin, by).join(level, by)
    asked = placed.select(
        *by, date_col, "_level", *[F.col(f).alias(f"_next_{f}") for f in features], "horizon",
        F.sqrt("horizon").alias("horizon_sqrt"), (F.col("horizon") * F.col("horizon")).alias("horizon_sq"),
        *changes, *[F.col(f"_o.{c}").alias(c) for c in columns],
    )
    bounds = horizon_bounds(pairs, by).select(*by, F.col("horizon").alias("_h"), "floor", "ceiling")
    reach = bounds.groupBy(*by).agg(F.max("_h").alias("_most"))
    scored = fitted.predict(asked, "_change").join(reach, by).withColumn("_h", F.least("horizon", "_most"))
    bounded = scored.join(bounds, [*by, "_h"])
    scale = F.col("horizon") / F.col("_h")
    change = F.least(F.greatest(F.col("_change"), F.col("floor") * scale), F.col("ceiling") * scale)
    made = bounded.withColumn("forecast", F.col("_level") + change)
    before = F.lag("forecast").over(Window.partitionBy(*by).orderBy("horizon"))
    out = made.withColumn("monthly_change", F.col("forecast") - F.coalesce(before, F.col("_level")))
    found = out.select(*by, "horizon", "forecast", "monthly_change", *[F.col(f"_next_{f}").alias(f) for f in features])
    return _every_horizon(base, found, date_col, horizon, by).select(*keys, date_col, "horizon", "forecast", "monthly_change", *features, "reason")


def _every_horizon(base: DataFrame, found: DataFrame, date_col: str, horizon: int, by: Sequence[str]) -> DataFrame:
    """All series and horizons with their forecast, or with the reason why there is none."""
    dates = future_calendar(base, date_col, horizon, by, date_col).select(*by, date_col, F.col("horizon").cast("long").alias("horizon"))
    joined = dates.join(found.withColumn("horizon", F.col("horizon").cast("long")), [*by, "horizon"], "left")
    return joined.withColumn("reason", F.when(F.col("forecast").isNull(), "too few complete rows"))


def _recent_mean(history: Column, rows: int) -> Column:
    tail = F.slice(history, -rows, rows)
    return F.aggregate(tail, F.lit(0.0), lambda a, v: a + v) / rows


def recursive_forecast(
    df: DataFrame,
    date_col: str,
    target: str,
    features: Sequence[str],
    horizon: int,
    keys: Sequence[str] = (),
    model: str = "Ridge",
    lags: Sequence[int] = (1, 3, 6, 12),
    windows: Sequence[int] = (3, 6, 12),
    grain: str = "month",
    params: dict | None = None,
) -> DataFrame:
    """A one-step model applied to its own output, features held at their last value.

    The state of a series is the array of its last values; no more of it is collected.  With a
    linear model the recursion is one fold over that array, with any other each horizon scores
    all series together and is cut off by a checkpoint.  A series without so many values has a
    NULL forecast and a ``reason``.
    """
    table, by = _keyed(df.select(*keys, date_col, target, *features), keys)
    base = forward_fill(table, features, by, [date_col], grain) if features else table
    lagged = lag_features(base, target, features, [date_col], by, lags, windows, grain)
    used = [
        *[f"{target}_lag{n}" for n in lags], *[f"{target}_rollmean{n}" for n in windows], f"{target}_diff1", *[f"{f}_lag1" for f in features],
    ]
    train = lagged.filter(F.col(target).isNotNull()).dropna("any", subset=used)
    train = train.withColumn(ROW, F.xxhash64(*by, date_col))  # breaks ties between neighbours
    fitted = fit_model(train, target, used, model, params=params, key=ROW)
    depth = max([*lags, *windows, 2])
    point = F.struct(F.col(date_col), F.col(target).cast("double").alias("v"))
    latest = Window.partitionBy(*by).orderBy(F.desc(date_col))
    ends = base.filter(F.col(target).isNotNull()).withColumn("_nth", F.row_number().over(latest)).filter(F.col("_nth") <= depth)
    state = ends.groupBy(*by).agg(
        F.transform(F.sort_array(F.collect_list(point)), lambda p: p["v"]).alias("_recent"),
        *[F.max_by(F.col(f).cast("double"), F.col(date_col)).alias(f"_hold_{f}") for f in features],
    ).filter(F.size("_recent") == depth)

    def inputs(history: Column) -> list[Column]:
        return [
            *[F.try_element_at(history, F.lit(-n)) for n in lags], *[_recent_mean(history, n) for n in windows],
            F.try_element_at(history, F.lit(-1)) - F.try_element_at(history, F.lit(-2)), *[F.col(f"_hold_{f}") for f in features],
        ]

    grown = _folded(state, fitted, inputs, horizon, depth) if has_linear_terms(fitted) else _stepped(state, fitted, inputs, used, horizon, depth, by)
    made = grown.select(*by, F.posexplode("_made").alias("_i", "forecast"))
    made = made.select(*by, (F.col("_i") + 1).cast("long").alias("horizon"), "forecast")
    return _every_horizon(base, made, date_col, horizon, by).select(*keys, date_col, "horizon", "forecast", "reason")


def _folded(state: DataFrame, fitted: Fitted, inputs: Callable[[Column], list[Column]], horizon: int, depth: int) -> DataFrame:
    weights, intercept = linear_terms(fitted)

    def step(history: Column, _: Column) -> Column:
        guess = F.lit(intercept)
        for w, v in zip(weights, inputs(history), strict=True):
            guess = guess + F.lit(w) * v
        return F.concat(history, F.array(guess))

    grown = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("_recent"), step)
    return state.withColumn("_made", F.slice(grown, depth + 1, horizon))


def _stepped(
    state: DataFrame, fitted: Fitted, inputs: Callable[[Column], list[Column]], used: Sequence[str], horizon: int, depth: int, by: Sequence[str]
) -> DataFrame:
    """One pass per horizon over one row per series: a guess takes the place of the oldest value."""
    work_dir(state.sparkSession)
    held = [c for c in state.columns if c not in (*by, "_recent")]
    now = state.withColumn("_made", F.array().cast("array<double>"))
    for _ in range(horizon):
        asked = now.withColumns(dict(zip(used, inputs(F.col("_recent")), strict=True)))
        guess = F.array("_guess")
        now = fitted.predict(asked, "_guess").select(
            *by, *held, F.slice(F.concat("_recent", guess), 2, depth).alias("_recent"), F.concat("_made", guess).alias("_made")
        ).checkpoint()
    return now


def has_linear_terms(fitted: Fitted) -> bool:
    return fitted.pipeline is not None and hasattr(fitted.pipeline.stages[-1], "coefficients")


def linear_terms(fitted: Fitted) -> tuple[list[float], float]:
    """Weights on the raw features and the intercept of a fitted linear model."""
    if not has_linear_terms(fitted):
        raise ValueError(f"{fitted.name} has no linear terms; choose LinearRegression, Ridge or ElasticNet")
    last = fitted.pipeline.stages[-1]
    weights = [float(w) / s for w, s in zip(last.coefficients, fitted.step.scale, strict=True)]
    shift = sum(w * m for w, m in zip(weights, fitted.step.shift, strict=True))
    return weights, float(last.intercept) - shift
