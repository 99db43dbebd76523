"""Time series: windows, lags, splits, states, period verdicts and horizons.

``keys`` name the series, ``grain`` declares that a series has at most one row per
calendar step ("month", "day", ...), which bounds it.  Without a grain a series may be
any share of the table and is processed in chunks (see ``ordinal.windowed``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions import rules
from tablewright.functions.columns import one_row, ratio, sort_key
from tablewright.operators.intervals import interval_join
from tablewright.operators.ordinal import running, windowed
from tablewright.operators.quantiles import quantile_values, quantiles
from tablewright.operators.selection import cuts, first_rows


def _stamp(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def month_of(date: str | Column) -> Column:
    return F.date_trunc("month", F.col(date) if isinstance(date, str) else date).cast("timestamp_ntz")


def monthly_series(df: DataFrame, date_col: str, measures: dict[str, Column], keys: Sequence[str] = (), name: str = "month") -> DataFrame:
    """One row per key and month; the sums are combined before the shuffle."""
    return df.groupBy(*keys, month_of(date_col).alias(name)).agg(*[c.alias(n) for n, c in measures.items()])


def _full(value: str, window: WindowSpec, start: int, end: int, f=F.avg) -> Column:
    """Frame aggregate that is NULL until every row of the frame has a value."""
    frame = window.rowsBetween(start, end)
    return F.when(F.count(value).over(frame) == end - start + 1, f(value).over(frame))


def rolling_mean(df: DataFrame, value: str, window_rows: int, order: Sequence[str], keys: Sequence[str] = (), grain: str | None = None, name: str = "rolling_mean", **how) -> DataFrame:
    """Trailing mean over ``window_rows`` rows."""
    build = lambda w: [{name: _full(value, w, 1 - window_rows, 0)}]
    return windowed(df, keys, order, build, back=window_rows - 1, grain=grain, **how)


def lag_features(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    order: Sequence[str],
    keys: Sequence[str] = (),
    lags: Sequence[int] = (1, 3, 6, 12),
    windows: Sequence[int] = (3, 6, 12),
    grain: str | None = None,
    **how,
) -> DataFrame:
    """Lags, changes and rolling statistics that only use rows before the current one."""
    change = "_change"

    def build(w: WindowSpec) -> list[dict[str, Column]]:
        made: dict[str, Column] = {}
        for n in lags:
            made[f"{target}_lag{n}"] = F.lag(target, n).over(w)
            made[f"{target}_change_lag{n}"] = F.lag(change, n).over(w)
        for n in windows:
            made[f"{target}_rollmean{n}"] = _full(target, w, -n, -1)
            made[f"{target}_change_rollmean{n}"] = _full(change, w, -n, -1)
            made[f"{target}_change_rollstd{n}"] = _full(change, w, -n, -1, F.stddev_samp)
        made[f"{target}_diff1"] = F.lag(change, 1).over(w)
        for f in features:
            made[f"{f}_lag1"] = F.lag(f, 1).over(w)
            made[f"{f}_change_lag1"] = F.lag(f, 1).over(w) - F.lag(f, 2).over(w)
        return [{change: F.col(target) - F.lag(target, 1).over(w)}, made]

    reach = max([*lags, *windows, 1]) + 1
    return windowed(df, keys, order, build, back=reach, grain=grain, **how).drop(change)


def pct_change(df: DataFrame, value: str, order: Sequence[str], keys: Sequence[str] = (), grain: str | None = None, name: str = "change", first: float | None = None, **how) -> DataFrame:
    """Relative change to the previous row; NULL over a zero, ``first`` where undefined."""

    def build(w: WindowSpec) -> list[dict[str, Column]]:
        before = F.lag(value, 1).over(w)
        moved = ratio(F.col(value) - before, before)
        return [{name: F.coalesce(moved, F.lit(first)) if first is not None else moved}]

    return windowed(df, keys, order, build, back=1, grain=grain, **how)


def rolling_std(df: DataFrame, value: str, window_rows: int, order: Sequence[str], keys: Sequence[str] = (), grain: str | None = None, name: str = "volatility", **how) -> DataFrame:
    """Trailing sample deviation, 0 while there are fewer than two values."""
    build = lambda w: [{name: F.coalesce(F.stddev_samp(value).over(w.rowsBetween(1 - window_rows, 0)), F.lit(0.0))}]
    return windowed(df, keys, order, build, back=window_rows - 1, grain=grain, **how)


def next_value(df: DataFrame, value: str, order: Sequence[str], keys: Sequence[str] = (), grain: str | None = None, name: str = "next_value", **how) -> DataFrame:
    """Value of the following row; the last row of a series is dropped."""
    build = lambda w: [{name: F.lead(value, 1).over(w), "_more": F.lead(F.lit(1), 1).over(w)}]
    return windowed(df, keys, order, build, ahead=1, grain=grain, **how).filter("_more = 1").drop("_more")


@dataclass(frozen=True)
class Split:
    """A chronological split: ``train`` is a predicate on the rows of the table."""

    train: Column
    method: str
    train_rows: int
    test_rows: int
    test_start: str | None

    def table(self, df: DataFrame) -> DataFrame:
        row = [(self.method, self.train_rows, self.test_rows, self.test_start)]
        return df.sparkSession.createDataFrame(row, "method string, train_rows long, test_rows long, test_start string")


def chronological_split(
    df: DataFrame,
    date_col: str,
    tiebreak: Sequence[str] = (),
    start: str = rules.EVENT_START,
    resume: str = rules.EVENT_RESUME,
    preferred: str | None = None,
) -> Split:
    """Train on the earlier rows.  Default 80/20; an event that the cut would leave wholly
    in the test part moves the cut to ``resume``; a preferred date wins when both parts
    stay large enough."""
    order = [date_col, *tiebreak]
    date = F.col(date_col)
    wish = _stamp(preferred) if preferred else None
    facts = one_row(
        df,
        F.count("*").alias("n"),
        F.min(date).alias("lo"),
        F.max(date).alias("hi"),
        F.count(F.when(date < _stamp(resume), 1)).alias("early"),
        F.count(F.when(date >= _stamp(resume), 1)).alias("late"),
        F.coalesce(F.max(date < _stamp(start)), F.lit(False)).alias("before"),
        *([F.count(F.when(date < wish, 1)).alias("w_early"), F.count(F.when(date >= wish, 1)).alias("w_late")] if preferred else []),
    )
    n = facts["n"]
    if n < 2:
        return Split(F.lit(True), "too few rows", n, 0, None)
    cut = max(1, min(int(n * 0.8), n - 1))
    need_test = min(12, max(1, n // 10))
    train, method = None, "80/20 chronological split"
    # The last training row of the default cut lies before ``resume`` exactly when ``early`` reaches it.
    if facts["before"] and facts["late"] and facts["early"] >= cut and n - facts["early"] >= need_test:
        cut, train, method = facts["early"], date < _stamp(resume), "chronological split inside the event window"
    if preferred and facts["w_late"] and facts["w_early"] >= min(24, max(1, n - 1)) and n - facts["w_early"] >= need_test:
        cut, train, method = facts["w_early"], date < wish, f"date split from {preferred}"
    if train is None:
        train = first_rows(df, order, cut)
    train = F.coalesce(train, F.lit(False))
    begin = one_row(df.filter(~train), F.date_format(F.min(date), "yyyy-MM-dd").alias("d"))["d"]
    return Split(train, method, cut, n - cut, begin)


def fold_bounds(df: DataFrame, order: Sequence[str], folds: int = 5) -> list[Column]:
    """Predicates "row lies before bound i" of an expanding-window validation.

    The test blocks are the last ``folds`` equal blocks; the first block takes what is left.
    """
    n = df.count()
    block = n // (folds + 1)
    bounds = [n - (folds - i) * block for i in range(folds + 1)]
    inner = cuts(df, order, [b for b in bounds if b < n])
    return [inner.pop(0) if b < n else F.lit(True) for b in bounds]


def time_series_folds(df: DataFrame, order: Sequence[str], folds: int = 5) -> DataFrame:
    """Rows with ``fold``: 0 is the first training block, fold i is tested after training on all before it."""
    within = fold_bounds(df, order, folds)
    fold = F.when(within[0], 0)
    for i, inside in enumerate(within[1:], start=1):
        fold = fold.when(inside, i)
    return df.withColumn("fold", fold.cast("long"))


def event_features(df: DataFrame, date_col: str, windows=rules.EVENT_WINDOWS, start: str = rules.EVENT_START) -> tuple[DataFrame, list[str]]:
    """0/1 columns per event window, months since the event began, and their log."""
    date = F.col(date_col)
    made: dict[str, Column] = {}
    for name, first, last in windows:
        inside = date >= _stamp(first)
        if last is not None:
            inside = inside & (date <= _stamp(last))
        made[name] = F.coalesce(inside.cast("int"), F.lit(0))
    months = (F.year(date) - F.year(_stamp(start))) * 12 + F.month(date) - F.month(_stamp(start))
    since = F.coalesce(F.greatest(months, F.lit(0)), F.lit(0)).cast("double")
    made["event_months_since"] = F.when(date.isNull(), 0.0).otherwise(since)
    made["event_months_since_log"] = F.log1p(made["event_months_since"])
    return df.withColumns(made), list(made)


def regime_weights(df: DataFrame, date_col: str, start: str = rules.EVENT_START, recent_months: int = 36, name: str = "weight") -> DataFrame:
    """0.45 for old rows, 1.35 from the event, 2.0 for the latest months, 1.0 without a date."""
    latest = one_row(df, F.max(date_col).cast("string").alias("d"))["d"]
    date = F.col(date_col)
    weight = F.when(date.isNull(), 1.0)
    if latest is not None:
        recent = F.lit(latest).cast("timestamp_ntz") - F.make_ym_interval(F.lit(0), F.lit(recent_months))
        weight = weight.when(date >= recent, 2.0)
    return df.withColumn(name, weight.when(date >= _stamp(start), 1.35).otherwise(0.45))


def period_verdicts(df: DataFrame, date_col: str, target: str, periods=rules.MARKET_PERIODS, keys: Sequence[str] = (), tiebreak: Sequence[str] = ()) -> DataFrame:
    """Change of the target inside each named period against the expected direction.

    A list of periods is a literal array; a row is matched by an expression, not a join.  A table of them (period, expected,
    start, end; of any size, ends of the date's type and included) goes through ``interval_join``.
    """
    known = df.filter(F.col(date_col).isNotNull() & F.col(target).isNotNull())
    if isinstance(periods, DataFrame):
        named = periods.select(F.struct("period", "expected").alias("_p"), F.col("start").alias("_start"), F.col("end").alias("_end"))
        rows = interval_join(known, named, date_col, "_start", "_end")
    else:
        names = F.array(
            *[F.struct(F.lit(n).alias("period"), F.lit(e).alias("expected"), _stamp(a).alias("a"), _stamp(b).alias("b")) for n, a, b, e in periods]
        )
        inside = F.filter(names, lambda p: F.col(date_col).between(p["a"], p["b"]))
        rows = known.withColumn("_p", F.explode(inside))
    order = sort_key([date_col, *tiebreak])
    found = rows.groupBy(*keys, F.col("_p.period").alias("period"), F.col("_p.expected").alias("expected")).agg(
        F.count("*").alias("n"),
        F.min_by(target, order).cast("double").alias("first_value"),
        F.max_by(target, order).cast("double").alias("last_value"),
        F.date_format(F.min(date_col), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max(date_col), "yyyy-MM-dd").alias("last_day"),
    )
    change = F.col("last_value") - F.col("first_value")
    moved = F.when(change > 0, "Rise").when(change < 0, "Fall").otherwise("Flat")
    verdict = (
        F.when(F.col("expected") == "Mixed", "Consistent with mixed real-world forces")
        .when(F.col("expected") == moved, "Matches real-life expectation")
        .otherwise("Challenges simple theory")
    )
    return found.filter("n >= 2").withColumns(
        {"change": change, "change_pct": ratio(change * 100, F.col("first_value")), "direction": moved, "verdict": verdict}
    )


def latest_change(df: DataFrame, date_col: str, target: str, keys: Sequence[str] = (), rows_back: int = 12, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Last value minus the value ``rows_back - 1`` rows earlier; series that are too short are left out.

    Only the last rows are kept, and that limit is applied before any shuffle.
    """
    known = df.filter(F.col(date_col).isNotNull() & F.col(target).isNotNull())
    late = [F.col(c).desc() for c in (date_col, *tiebreak)]
    if keys:
        last = Window.partitionBy(*keys).orderBy(*late)
        tail = known.withColumn("_rn", F.row_number().over(last)).filter(F.col("_rn") <= rows_back)
    else:
        tail = known.orderBy(*late).limit(rows_back)
    order = sort_key([date_col, *tiebreak])
    ends = tail.groupBy(*keys).agg(F.count("*").alias("n"), F.max_by(target, order).alias("b"), F.min_by(target, order).alias("a"))
    return ends.filter(F.col("n") >= rows_back).select(*keys, (F.col("b") - F.col("a")).cast("double").alias("latest_change"))


def horizon_rows(
    df: DataFrame,
    date_col: str,
    target: str,
    features: Sequence[str],
    horizon: int,
    keys: Sequence[str] = (),
    grain: str | None = None,
    keep: Sequence[str] = (),
    most: int = 24,
) -> DataFrame:
    """Every row paired with the rows 1..H steps later: cumulative change, horizon terms and
    future changes of the features.  H is at most a quarter of the series."""
    limit = min(horizon, most)
    if keys:
        sized = df.join(df.groupBy(*keys).agg(F.count("*").alias("_n")), list(keys)) if not grain else df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    else:
        sized = df.withColumn("_n", F.lit(df.count()))

    def build(w: WindowSpec) -> list[dict[str, Column]]:
        steps = [
            F.struct(
                F.lit(h).alias("horizon"),
                (F.lead(target, h).over(w) - F.col(target)).alias("cumulative_change"),
                *[(F.lead(f, h).over(w) - F.col(f)).alias(f"{f}_future_change") for f in features],
                F.lead(F.lit(1), h).over(w).alias("_there"),
            )
            for h in range(1, limit + 1)
        ]
        return [{"_steps": F.array(*steps)}]

    order = [date_col]
    fanned = windowed(sized, keys, order, build, ahead=limit, grain=grain)
    reach = F.least(F.lit(limit), F.greatest(F.lit(1), F.floor(F.col("_n") / 4)))
    pairs = fanned.select(*keys, date_col, target, *keep, reach.alias("_h"), F.explode("_steps").alias("s"))
    pairs = pairs.filter((F.col("s.horizon") <= F.col("_h")) & (F.col("s._there") == 1) & F.col("s.cumulative_change").isNotNull())
    return pairs.select(
        *keys, date_col, target, *keep, "s.horizon", "s.cumulative_change", *[f"s.{f}_future_change" for f in features]
    ).withColumns({"horizon_sqrt": F.sqrt("horizon"), "horizon_sq": F.col("horizon") * F.col("horizon")})


def horizon_bounds(pairs: DataFrame, keys: Sequence[str] = (), **how) -> DataFrame:
    """1 % and 99 % of the cumulative change per horizon; the floor is 0 when it never fell."""
    by = [*keys, "horizon"]
    q = quantiles(pairs, ["cumulative_change"], [0.01, 0.99], by=by, **how)
    least = pairs.groupBy(*by).agg(F.min("cumulative_change").alias("least"), F.count("*").alias("n"))
    joined = q.join(least, by)
    floor = F.when(F.col("least") >= 0, 0.0).otherwise(F.col("q")[0])
    return joined.select(*by, "n", floor.alias("floor"), F.col("q")[1].alias("ceiling"))


HOLD, REPEAT, TREND, BLEND = "hold", "repeat", "trend", "blend"


def project_features(df: DataFrame, date_col: str, feature: str, horizon: int, mode: str = BLEND, keys: Sequence[str] = ()) -> DataFrame:
    """Future values of a feature per series: hold, repeat the last year, trend or blend.

    Series must be at a calendar grain: the values of one series are folded as an array.
    """
    point = F.struct(F.col(date_col), F.col(feature).cast("double").alias("v"))
    per = df.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(point)), lambda p: p["v"]).alias("raw"),
        F.percentile(F.col(feature).cast("double"), F.array(F.lit(0.01), F.lit(0.99))).alias("edge"),
    )
    per = per.withColumn("known", F.filter("raw", lambda v: v.isNotNull())).filter(F.size("known") > 0)
    n = F.size("known")
    last7 = F.slice("known", F.greatest(n - 6, F.lit(1)), 7)
    steps = F.sort_array(F.transform(F.sequence(F.lit(2), F.lit(7)), lambda i: F.get(last7, i - 1) - F.get(last7, i - 2)))
    middle = (F.get(steps, F.lit(2)) + F.get(steps, F.lit(3))) / 2
    per = per.withColumn("step", F.when(n >= 7, middle).otherwise(0.0))
    horizon_steps = F.sequence(F.lit(1), F.lit(horizon))

    def clipped(v: Column) -> Column:
        return F.when(n >= 20, F.least(F.greatest(v, F.col("edge")[0]), F.col("edge")[1])).otherwise(v)

    latest = lambda acc: F.element_at(acc, -1)
    year_back = lambda acc: F.element_at(acc, -12)

    def blend(acc: Column) -> Column:
        season = F.when(F.size(acc) >= 12, (latest(acc) - F.try_element_at(acc, F.lit(-12))) / 12).otherwise(0.0)
        return clipped(latest(acc) + 0.65 * F.col("step") + 0.35 * season)

    if mode == HOLD:
        values = F.array_repeat(latest(F.col("known")), horizon)
    elif mode == TREND:
        grown = F.aggregate(horizon_steps, F.col("known"), lambda acc, _: F.concat(acc, F.array(clipped(latest(acc) + F.col("step")))))
        values = F.slice(grown, n + 1, horizon)
    elif mode == REPEAT:
        again = F.aggregate(horizon_steps, F.col("raw"), lambda acc, _: F.concat(acc, F.array(year_back(acc))))
        fold = F.aggregate(horizon_steps, F.col("known"), lambda acc, _: F.concat(acc, F.array(blend(acc))))
        values = F.when(F.size("raw") >= 12, F.slice(again, F.size("raw") + 1, horizon)).otherwise(F.slice(fold, n + 1, horizon))
    else:
        grown = F.aggregate(horizon_steps, F.col("known"), lambda acc, _: F.concat(acc, F.array(blend(acc))))
        values = F.slice(grown, n + 1, horizon)
    out = per.select(*keys, F.posexplode(values).alias("_i", feature))
    return out.select(*keys, (F.col("_i") + 1).cast("long").alias("horizon"), feature)


def future_calendar(df: DataFrame, date_col: str, horizon: int, keys: Sequence[str] = (), name: str = "month") -> DataFrame:
    """The next month starts after the last date of each series."""
    start = F.add_months(F.trunc(F.max(date_col), "MM"), 1)
    ends = df.groupBy(*keys).agg(start.alias("a"))
    dates = F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda i: F.add_months(F.col("a"), i))
    spread = ends.filter("a IS NOT NULL").select(*keys, F.posexplode(dates).alias("_i", "_d"))
    return spread.select(*keys, (F.col("_i") + 1).cast("long").alias("horizon"), F.col("_d").cast("timestamp_ntz").alias(name))


def history_plus_forecast(history: DataFrame, forecast: DataFrame, date_col: str, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """The last actual row of each series stitched before its forecast rows."""
    known = history.filter(F.col(target).isNotNull() & F.col(date_col).isNotNull())
    last = known.groupBy(*keys).agg(F.max(date_col).alias(date_col), F.max_by(target, date_col).cast("double").alias("forecast"))
    return last.unionByName(forecast, allowMissingColumns=True)


def momentum_state(change: Column, edge: float = 0.005) -> Column:
    """Falling, Flat or Rising; the edges belong to the lower state."""
    return F.when(change <= -edge, "Falling").when(change <= edge, "Flat").when(change.isNotNull(), "Rising")


def quantile_code(value: Column, edges: Sequence[float]) -> Column:
    """Bin number for right-closed bins between the distinct ``edges``; the lowest edge is included."""
    inner = sorted(set(edges))
    code = sum((F.when(value > F.lit(float(e)), 1).otherwise(0) for e in inner[1:-1]), F.lit(0))
    return F.when(value.isNotNull() & (value >= F.lit(float(inner[0]))) & (value <= F.lit(float(inner[-1]))), code)


def quantile_edges(df: DataFrame, value: str, bins: int, **how) -> list[float]:
    probs = [i / bins for i in range(bins + 1)]
    return quantile_values(df, [value], probs, **how)[value]


def tertile_state(df: DataFrame, value: str, name: str = "state", names: Sequence[str] = tuple(rules.LEVELS), **how) -> DataFrame:
    """Low, Medium, High by exact quantile edges; a single level when edges coincide."""
    edges = quantile_edges(df, value, len(names), **how)
    if edges[0] is None or len(set(edges)) != len(names) + 1:
        return df.withColumn(name, F.lit("One-level"))
    code = quantile_code(F.col(value).cast("double"), edges)
    picked = F.get(F.array(*[F.lit(n) for n in names]), code)
    return df.withColumn(name, picked)


def market_states(df: DataFrame, date_col: str, target: str, keys: Sequence[str], signal: str | None = None, grain: str | None = None, **how) -> DataFrame:
    """Return, next return, volatility and the combined state of every row but the last of a series."""
    known = df.filter(F.col(date_col).isNotNull() & F.col(target).isNotNull())

    def build(w: WindowSpec) -> list[dict[str, Column]]:
        before, after = F.lag(target, 1).over(w), F.lead(target, 1).over(w)
        first = {
            "current_return": F.coalesce(ratio(F.col(target) - before, before), F.lit(0.0)),
            "next_return": ratio(after - F.col(target), F.col(target)),
            "has_next": F.lead(target, 2).over(w).isNotNull(),
        }
        return [first, {"volatility": F.coalesce(F.stddev_samp("current_return").over(w.rowsBetween(-5, 0)), F.lit(0.0))}]

    moved = windowed(known, keys, [date_col], build, back=6, ahead=2, grain=grain).filter("next_return IS NOT NULL")
    if signal:
        moved = tertile_state(moved, signal, "signal_state", **how)
    else:
        moved = moved.withColumn("signal_state", F.lit("No extra signal"))
    mood = momentum_state(F.col("current_return"))
    return moved.withColumn("momentum_state", mood).withColumn(
        "state", F.concat("momentum_state", F.lit(" market | "), "signal_state", F.lit(" signal"))
    )


def state_transitions(states: DataFrame, date_col: str, keys: Sequence[str], grain: str | None = None) -> DataFrame:
    """How often each state is followed by which, with the mean next return and volatility."""
    build = lambda w: [{"next_state": F.lead("state", 1).over(w)}]
    steps = windowed(states, keys, [date_col], build, ahead=1, grain=grain).filter("next_state IS NOT NULL")
    counted = steps.groupBy("state", "next_state").agg(
        F.count("*").alias("n"), F.avg("next_return").alias("next_return"), F.avg("volatility").alias("volatility")
    )
    of_state = Window.partitionBy("state")
    return counted.withColumn("share", F.col("n") / F.sum("n").over(of_state))


def _reward(actions, risk_penalty: float) -> Column:
    move, risk = F.col("next_return") * 100, F.col("volatility") * 100 * risk_penalty
    return F.array(
        *[F.struct(F.lit(name).alias("action"), (move * gain - risk * cost).alias("reward")) for name, gain, cost in actions]
    )


def policy_rewards(states: DataFrame, actions=rules.ACTIONS, risk_penalty: float = 1.0) -> DataFrame:
    """Mean reward per state and action over all steps to a next state, and the best action of each state."""
    tried = states.filter("has_next").withColumn("_a", F.explode(_reward(actions, risk_penalty)))
    scored = tried.groupBy("state", F.col("_a.action").alias("action")).agg(F.avg("_a.reward").alias("mean_reward"), F.count("*").alias("n"))
    best = F.min_by("action", F.struct((-F.col("mean_reward")).alias("r"), "action")).over(Window.partitionBy("state"))
    return scored.withColumn("best_action", best)


def policy_trace(states: DataFrame, date_col: str, keys: Sequence[str], actions=rules.ACTIONS, risk_penalty: float = 1.0, grain: str | None = None) -> DataFrame:
    """Follow the best action of each state and sum up the rewards along every series."""
    policy = policy_rewards(states, actions, risk_penalty).filter("action = best_action").select("state", "best_action")
    chosen = states.filter("has_next").withColumn("_all", _reward(actions, risk_penalty)).join(policy, "state")
    reward = F.get(F.filter("_all", lambda a: a["action"] == F.col("best_action")), F.lit(0))["reward"]
    rewarded = chosen.withColumn("reward", reward).drop("_all")
    return running(rewarded, keys, [date_col], sums={"cumulative_reward": "reward"}, grain=grain)
