"""Time series: windows, lags, splits, states, horizons."""

from pyspark.sql import functions as F

from tablewright.functions import labels
from tablewright.operators import intervals, series
from tablewright.plans.inputs import LINE_KEY, LINE_ORDER, MONTHS_SQL, SEGMENTS_SQL, months, segment_months
from tablewright.plans.registry import day, query, rounded, table
from tablewright.plans.tables import each

SEGMENT = ["segment"]
S = f"WITH s AS ({SEGMENTS_SQL}) "
M = f"WITH m AS ({MONTHS_SQL}) "
OVER = "OVER (PARTITION BY segment ORDER BY month)"
MONTH = "strftime(month, '%Y-%m-%d') AS month"

PERIODS = [
    ("Opening", "1995-01-01", "1996-12-31", "Rise"),
    ("Middle", "1997-01-01", "1998-12-31", "Fall"),
    ("Plateau", "1999-01-01", "1999-12-31", "Mixed"),
    ("Close", "2000-01-01", "2001-12-31", "Fall"),
    ("Never", "2005-01-01", "2006-12-31", "Rise"),
]
WINDOWS = [("event_dip", "1998-01-01", "1999-06-01"), ("event_late", "2000-01-01", None)]


@query("monthly_series", S + f"SELECT segment, {MONTH}, revenue, orders, ticket FROM s")
def monthly_series(spark, sf):
    return segment_months(spark, sf).withColumn("month", day("month"))


_FRAME = "(PARTITION BY segment ORDER BY month ROWS {w} PRECEDING)"


def _rolled(order: str, value: str, w: int, by: str = "") -> str:
    frame = f"({by} ORDER BY {order} ROWS {w - 1} PRECEDING)"
    return f"round(CASE WHEN count({value}) OVER {frame} = {w} THEN avg({value}) OVER {frame} END, 4) AS rolling_mean"


@query("rolling_mean", S + f"SELECT segment, {MONTH}, {_rolled('month', 'revenue', 6, 'PARTITION BY segment')} FROM s")
def rolling_mean(spark, sf):
    made = series.rolling_mean(segment_months(spark, sf), "revenue", 6, ["month"], SEGMENT, "month")
    return rounded(made.select("segment", day("month").alias("month"), "rolling_mean"))


@query("rolling_mean_rows", f"SELECT event_id, {_rolled('ts, event_id', 'value', 6)} FROM events")
def rolling_mean_rows(spark, sf):
    made = series.rolling_mean(table(spark, sf, "events").select("event_id", "ts", "value"), "value", 6, ["ts", "event_id"])
    return rounded(made.select("event_id", "rolling_mean"))


def _prior(c: str, w: int, f: str = "avg") -> str:
    frame = f"(PARTITION BY segment ORDER BY month ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return f"round(CASE WHEN count({c}) OVER {frame} = {w} THEN {f}({c}) OVER {frame} END, 4)"


_LAGS = ", ".join(
    [f"round(lag(revenue, {n}) {OVER}, 4) AS revenue_lag{n}, round(lag(d, {n}) {OVER}, 4) AS revenue_change_lag{n}" for n in (1, 3, 6, 12)]
    + [
        f"{_prior('revenue', w)} AS revenue_rollmean{w}, {_prior('d', w)} AS revenue_change_rollmean{w}, {_prior('d', w, 'stddev_samp')} AS revenue_change_rollstd{w}"
        for w in (3, 6, 12)
    ]
)


@query(
    "lag_features",
    S
    + f""", c AS (SELECT *, revenue - lag(revenue) {OVER} AS d, ticket - lag(ticket) {OVER} AS e FROM s)
 SELECT segment, {MONTH}, {_LAGS}, round(lag(d) {OVER}, 4) AS revenue_diff1, lag(ticket) {OVER} AS ticket_lag1,
 lag(e) {OVER} AS ticket_change_lag1 FROM c""",
)
def lag_features(spark, sf):
    made = series.lag_features(segment_months(spark, sf), "revenue", ["ticket"], ["month"], SEGMENT, grain="month")
    # Averages of a few amounts can end on a rounding edge; both engines have the same doubles, so they stay as they are.
    return rounded(made.drop("revenue", "orders", "ticket").withColumn("month", day("month")), 4, ("ticket_lag1", "ticket_change_lag1"))


@query("pct_change", S + f"SELECT segment, {MONTH}, round(coalesce(revenue / lag(revenue) {OVER} - 1, 0), 6) AS change FROM s")
def pct_change(spark, sf):
    made = series.pct_change(segment_months(spark, sf), "revenue", ["month"], SEGMENT, "month", first=0.0)
    return rounded(made.select("segment", day("month").alias("month"), "change"), 6)


@query(
    "rolling_std_min",
    S + f"SELECT segment, {MONTH}, round(coalesce(stddev_samp(ticket) OVER (PARTITION BY segment ORDER BY month ROWS 5 PRECEDING), 0), 4) AS volatility FROM s",
)
def rolling_std_min(spark, sf):
    made = series.rolling_std(segment_months(spark, sf), "ticket", 6, ["month"], SEGMENT, "month")
    return rounded(made.select("segment", day("month").alias("month"), "volatility"))


@query(
    "next_value",
    S + f"SELECT segment, {MONTH}, revenue, lead(revenue) {OVER} AS next_value FROM s QUALIFY lead(1) {OVER} = 1",
)
def next_value(spark, sf):
    made = series.next_value(segment_months(spark, sf), "revenue", ["month"], SEGMENT, "month")
    return made.select("segment", day("month").alias("month"), "revenue", "next_value")


_SPLIT = f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) AS rn, count(*) OVER () AS n FROM lineitem),
 k AS (SELECT *, floor(n * 0.8) AS cut FROM o) """


@query(
    "chronological_split",
    _SPLIT
    + """SELECT CASE WHEN rn <= cut THEN 'train' ELSE 'test' END AS part, count(*) AS n, strftime(min(l_shipdate), '%Y-%m-%d') AS first_day,
 sum(l_quantity) AS quantity, '80/20 chronological split' AS method FROM k GROUP BY 1""",
)
def chronological_split(spark, sf):
    lines = table(spark, sf, "lineitem")
    split = series.chronological_split(lines, "l_shipdate", LINE_KEY)
    part = F.when(split.train, "train").otherwise("test")
    return lines.groupBy(part.alias("part")).agg(
        F.count("*").alias("n"), F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("first_day"), F.sum("l_quantity").alias("quantity")
    ).withColumn("method", F.lit(split.method))


@query(
    "event_split",
    """SELECT CASE WHEN l_shipdate < TIMESTAMP '2000-12-01' THEN 'train' ELSE 'test' END AS part, count(*) AS n, sum(l_quantity) AS quantity,
 'chronological split inside the event window' AS method FROM lineitem GROUP BY 1""",
)
def event_split(spark, sf):
    lines = table(spark, sf, "lineitem")
    split = series.chronological_split(lines, "l_shipdate", LINE_KEY, start="2000-05-01", resume="2000-12-01")
    part = F.when(split.train, "train").otherwise("test")
    return lines.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")).withColumn("method", F.lit(split.method))


@query(
    "time_series_cv",
    f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) - 1 AS rn, count(*) OVER () AS n FROM lineitem),
 k AS (SELECT *, n - 5 * (n // 6) AS first_block, n // 6 AS block FROM o)
 SELECT (CASE WHEN rn < first_block THEN 0 ELSE (rn - first_block) // block + 1 END)::BIGINT AS fold, count(*) AS n, sum(l_quantity) AS quantity FROM k GROUP BY 1""",
)
def time_series_cv(spark, sf):
    folds = series.time_series_folds(table(spark, sf, "lineitem"), LINE_ORDER, 5)
    return folds.groupBy("fold").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


_SINCE = "greatest((year(o_orderdate) - 1998) * 12 + month(o_orderdate) - 1, 0)"


@query(
    "event_features",
    f"""SELECT o_orderkey, (o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate <= TIMESTAMP '1999-06-01')::BIGINT AS event_dip,
 (o_orderdate >= TIMESTAMP '2000-01-01')::BIGINT AS event_late, {_SINCE}::DOUBLE AS event_months_since, round(ln(1 + {_SINCE}), 6) AS event_months_since_log FROM orders""",
)
def event_features(spark, sf):
    made, names = series.event_features(table(spark, sf, "orders"), "o_orderdate", WINDOWS, "1998-01-01")
    flags = [F.col(w[0]).cast("long").alias(w[0]) for w in WINDOWS]
    return rounded(made.select("o_orderkey", *flags, *names[-2:]), 6)


@query(
    "regime_weights",
    """WITH l AS (SELECT max(o_orderdate) - INTERVAL 36 MONTH AS recent FROM orders)
 SELECT CASE WHEN o_orderdate >= recent THEN 2.0::DOUBLE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 1.35::DOUBLE ELSE 0.45::DOUBLE END AS weight,
 count(*) AS n FROM orders, l GROUP BY 1""",
)
def regime_weights(spark, sf):
    weighted = series.regime_weights(table(spark, sf, "orders"), "o_orderdate", "1998-01-01")
    return weighted.groupBy("weight").agg(F.count("*").alias("n"))


_PERIODS = "(VALUES " + ", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}', '{e}')" for n, a, b, e in PERIODS) + ") p(period, a, b, expected)"


def verdict_sql(source: str, by: str) -> str:
    return f"""SELECT {by} period, expected, count(*) AS n, arg_min(revenue, month) AS first_value, arg_max(revenue, month) AS last_value,
 strftime(min(month), '%Y-%m-%d') AS first_day, strftime(max(month), '%Y-%m-%d') AS last_day FROM {source}, {_PERIODS} WHERE month BETWEEN a AND b
 GROUP BY ALL HAVING count(*) >= 2"""


VERDICTS = """CASE WHEN expected = 'Mixed' THEN 'Consistent with mixed real-world forces'
 WHEN expected = direction THEN 'Matches real-life expectation' ELSE 'Challenges simple theory' END AS verdict"""


@query(
    "period_verdicts",
    S
    + f""", f AS ({verdict_sql('s', 'segment,')}), d AS (SELECT *, round(last_value - first_value, 4) AS change,
 round((last_value - first_value) / first_value * 100, 4) AS change_pct,
 CASE WHEN last_value > first_value THEN 'Rise' WHEN last_value < first_value THEN 'Fall' ELSE 'Flat' END AS direction FROM f) SELECT *, {VERDICTS} FROM d""",
)
def period_verdicts(spark, sf):
    return rounded(series.period_verdicts(segment_months(spark, sf), "month", "revenue", PERIODS, SEGMENT))


@query(
    "period_verdicts_table",
    S
    + f""", p AS (SELECT 'Quarter ' || strftime(min(month), '%Y-%m') AS period, CASE WHEN quarter(min(month)) % 2 = 0 THEN 'Rise' ELSE 'Mixed' END AS expected,
 min(month) AS a, max(month) AS b FROM s GROUP BY year(month), quarter(month)),
 f AS (SELECT segment, period, expected, count(*) AS n, round(arg_min(revenue, month), 4) AS first_value, round(arg_max(revenue, month), 4) AS last_value,
 strftime(min(month), '%Y-%m-%d') AS first_day, strftime(max(month), '%Y-%m-%d') AS last_day FROM s, p WHERE month BETWEEN a AND b GROUP BY ALL HAVING count(*) >= 2),
 d AS (SELECT *, round(last_value - first_value, 4) AS change, round((last_value - first_value) / first_value * 100, 4) AS change_pct,
 CASE WHEN last_value > first_value THEN 'Rise' WHEN last_value < first_value THEN 'Fall' ELSE 'Flat' END AS direction FROM f) SELECT *, {VERDICTS} FROM d""",
)
def period_verdicts_table(spark, sf):
    """Verdicts on the quarters of the series, which are a table."""
    rows = segment_months(spark, sf)
    ends = rows.groupBy(F.year("month"), F.quarter("month")).agg(F.min("month").alias("start"), F.max("month").alias("end")).select("start", "end")
    expected = F.when(F.quarter("start") % 2 == 0, "Rise").otherwise("Mixed")
    quarters = ends.select(F.concat(F.lit("Quarter "), F.date_format("start", "yyyy-MM")).alias("period"), expected.alias("expected"), "start", "end")
    return rounded(series.period_verdicts(rows, "month", "revenue", quarters, SEGMENT))


@query(
    "interval_join",
    """WITH held AS (SELECT l_suppkey, l_shipdate AS a, l_shipdate + to_days(CAST(l_quantity AS INTEGER)) AS b, l_extendedprice AS price
 FROM lineitem WHERE l_returnflag = 'R')
 SELECT l_orderkey, l_partkey, l.l_suppkey, l_linenumber, count(*) AS n_open, round(max(h.price), 4) AS dearest
 FROM lineitem l JOIN held h ON l.l_suppkey = h.l_suppkey AND l_shipdate >= a AND l_shipdate < b GROUP BY ALL""",
)
def interval_join(spark, sf):
    """Lines that a supplier shipped while returned goods of that supplier were under inspection, a day for each piece."""
    lines = table(spark, sf, "lineitem").select(*LINE_KEY, "l_shipdate")
    back = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    until = F.col("l_shipdate") + F.make_dt_interval(F.col("l_quantity").cast("int"))
    held = back.select("l_suppkey", F.col("l_shipdate").alias("since"), until.cast(back.schema["l_shipdate"].dataType).alias("until"), F.col("l_extendedprice").alias("price"))
    found = intervals.interval_join(lines, held, "l_shipdate", "since", "until", keys=["l_suppkey"], closed="left")
    return rounded(found.groupBy(*LINE_KEY).agg(F.count(F.lit(1)).alias("n_open"), F.max("price").alias("dearest")))


@query(
    "latest_change",
    S + f"""SELECT segment, round(max(revenue) FILTER (rn = 1) - max(revenue) FILTER (rn = 12), 4) AS latest_change
 FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY month DESC) AS rn FROM s) GROUP BY 1""",
)
def latest_change(spark, sf):
    return rounded(series.latest_change(segment_months(spark, sf), "month", "revenue", SEGMENT))


@query(
    "latest_change_rows",
    """SELECT round(max(value) FILTER (rn = 1) - max(value) FILTER (rn = 12), 4) AS latest_change
 FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM events)""",
)
def latest_change_rows(spark, sf):
    return rounded(series.latest_change(table(spark, sf, "events"), "ts", "value", tiebreak=["event_id"]))


_PAIRS = S + """, r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY month) AS rn, count(*) OVER (PARTITION BY segment) AS n FROM s),
 h AS (SELECT a.segment, a.month, a.revenue, k.h::BIGINT AS horizon, b.revenue - a.revenue AS cumulative_change, b.ticket - a.ticket AS ticket_future_change
 FROM r a JOIN range(1, 13) k(h) ON k.h <= least(12, greatest(1, a.n // 4)) JOIN r b ON b.segment = a.segment AND b.rn = a.rn + k.h) """


def _pairs(spark, sf):
    return series.horizon_rows(segment_months(spark, sf), "month", "revenue", ["ticket"], 12, SEGMENT, "month")


@query(
    "horizon_training_rows",
    _PAIRS
    + f"""SELECT segment, {MONTH}, horizon, round(cumulative_change, 4) AS cumulative_change, ticket_future_change,
 round(sqrt(horizon), 6) AS horizon_sqrt, horizon * horizon AS horizon_sq FROM h""",
)
def horizon_training_rows(spark, sf):
    pairs = _pairs(spark, sf).drop("revenue").withColumns(
        {"month": day("month"), "horizon": F.col("horizon").cast("long"), "horizon_sq": F.col("horizon_sq").cast("long")}
    )
    return rounded(rounded(pairs, 4, ("horizon_sqrt", "ticket_future_change")), 6, ("ticket_future_change",))


@query(
    "horizon_bounds",
    _PAIRS
    + """SELECT horizon, count(*) AS n, round(CASE WHEN min(cumulative_change) >= 0 THEN 0.0 ELSE quantile_cont(cumulative_change, 0.01) END, 4) AS floor,
 round(quantile_cont(cumulative_change, 0.99), 4) AS ceiling FROM h GROUP BY 1""",
)
def horizon_bounds(spark, sf):
    return rounded(series.horizon_bounds(_pairs(spark, sf)).withColumn("horizon", F.col("horizon").cast("long")))


@query(
    "project_features",
    S
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY month DESC) AS back FROM s),
 t AS (SELECT segment, quantile_cont(ticket, 0.01) AS lo, quantile_cont(ticket, 0.99) AS hi, max(ticket) FILTER (back = 1) AS x,
 median(st) FILTER (back <= 6) AS step FROM (SELECT *, ticket - lag(ticket) OVER (PARTITION BY segment ORDER BY month) AS st FROM r) GROUP BY 1),
 h AS (SELECT k::BIGINT AS horizon FROM range(1, 19) x(k)),
 one AS (SELECT *, least(greatest(x + step, lo), hi) AS x1 FROM t)
 SELECT 'hold' AS mode, segment, horizon, round(x, 4) AS ticket FROM t, h
 UNION ALL SELECT 'repeat', r.segment, horizon, round(ticket, 4) FROM r, h WHERE back = 12 - (horizon - 1) % 12
 UNION ALL SELECT 'trend', segment, horizon, round(least(greatest(x1 + (horizon - 1) * step, lo), hi), 4) FROM one, h""",
)
def project_features(spark, sf):
    parts = [
        series.project_features(segment_months(spark, sf), "month", "ticket", 18, mode, SEGMENT).withColumn("mode", F.lit(mode))
        for mode in (series.HOLD, series.REPEAT, series.TREND)
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("project_features_blend")
def project_features_blend(spark, sf):
    return rounded(series.project_features(segment_months(spark, sf), "month", "ticket", 18, series.BLEND, SEGMENT))


@query(
    "future_calendar",
    S + """, e AS (SELECT segment, max(month) AS last FROM s GROUP BY 1)
 SELECT segment, k::BIGINT AS horizon, strftime(last + to_months(k::INTEGER), '%Y-%m-%d') AS month FROM e, range(1, 13) x(k)""",
)
def future_calendar(spark, sf):
    made = series.future_calendar(segment_months(spark, sf), "month", 12, SEGMENT)
    return made.withColumn("month", day("month"))


@query(
    "history_plus_forecast",
    S + """, e AS (SELECT segment, max(month) AS last, arg_max(revenue, month) AS v FROM s GROUP BY 1)
 SELECT segment, strftime(last + to_months(k::INTEGER), '%Y-%m-%d') AS month, v AS forecast, CASE WHEN k > 0 THEN k END::DOUBLE AS horizon FROM e, range(0, 7) x(k)""",
)
def history_plus_forecast(spark, sf):
    history = segment_months(spark, sf)
    held = series.project_features(history, "month", "revenue", 6, series.HOLD, SEGMENT)
    dates = series.future_calendar(history, "month", 6, SEGMENT)
    forecast = dates.join(held, ["segment", "horizon"]).select(
        "segment", "month", F.col("revenue").alias("forecast"), F.col("horizon").cast("double").alias("horizon")
    )
    return series.history_plus_forecast(history, forecast, "month", "revenue", SEGMENT).withColumn("month", day("month"))


_MOVES = S + f", c AS (SELECT *, coalesce(revenue / lag(revenue) {OVER} - 1, 0) AS change FROM s) "


@query(
    "momentum_state",
    _MOVES + "SELECT segment, CASE WHEN change <= -0.005 THEN 'Falling' WHEN change <= 0.005 THEN 'Flat' ELSE 'Rising' END AS state, count(*) AS n FROM c GROUP BY 1, 2",
)
def momentum_state(spark, sf):
    moved = series.pct_change(segment_months(spark, sf), "revenue", ["month"], SEGMENT, "month", first=0.0)
    return moved.groupBy("segment", series.momentum_state(F.col("change")).alias("state")).agg(F.count("*").alias("n"))


def tertile_sql(source: str, value: str) -> str:
    return f"(SELECT quantile_cont({value}, 1.0/3) AS a, quantile_cont({value}, 2.0/3) AS b FROM {source})"


def level_sql(value: str) -> str:
    return f"CASE WHEN {value} <= a THEN 'Low' WHEN {value} <= b THEN 'Medium' ELSE 'High' END"


@query("tertile_state", f"SELECT o_orderkey, {level_sql('o_totalprice')} AS state FROM orders, {tertile_sql('orders', 'o_totalprice')}")
def tertile_state(spark, sf):
    return series.tertile_state(table(spark, sf, "orders"), "o_totalprice").select("o_orderkey", "state")


_STATES = S + f""", c AS (SELECT *, coalesce(revenue / lag(revenue) {OVER} - 1, 0) AS r, lead(revenue) {OVER} / revenue - 1 AS nr,
 lead(revenue, 2) {OVER} IS NOT NULL AS has_next FROM s),
 v AS (SELECT *, coalesce(stddev_samp(r) OVER (PARTITION BY segment ORDER BY month ROWS 5 PRECEDING), 0) AS vol FROM c),
 k AS (SELECT * FROM v WHERE nr IS NOT NULL),
 st AS (SELECT *, CASE WHEN r <= -0.005 THEN 'Falling' WHEN r <= 0.005 THEN 'Flat' ELSE 'Rising' END || ' market | ' || {level_sql('ticket')} || ' signal' AS state
 FROM k, {tertile_sql('k', 'ticket')}) """


def _states(spark, sf):
    return series.market_states(segment_months(spark, sf), "month", "revenue", SEGMENT, "ticket", "month")


@query(
    "state_transitions",
    _STATES
    + f""", t AS (SELECT *, lead(state) {OVER} AS next_state FROM st),
 g AS (SELECT state, next_state, count(*) AS n, round(avg(nr), 6) AS next_return, round(avg(vol), 6) AS volatility FROM t WHERE next_state IS NOT NULL GROUP BY 1, 2)
 SELECT *, round(n / sum(n) OVER (PARTITION BY state), 6) AS share FROM g""",
)
def state_transitions(spark, sf):
    return rounded(series.state_transitions(_states(spark, sf), "month", SEGMENT, "month"), 6)


_REWARDS = _STATES + """, a(action, gain, cost) AS (VALUES ('Buy / overweight', 1.0::DOUBLE, 1.0::DOUBLE), ('Hold / neutral', 0.45, 0.35), ('Wait / underweight', -0.35, 0.15)),
 q AS (SELECT state, action, avg(nr * 100 * gain - vol * 100 * cost) AS mean_reward, count(*) AS n FROM st, a WHERE has_next GROUP BY 1, 2),
 b AS (SELECT *, first_value(action) OVER (PARTITION BY state ORDER BY mean_reward DESC, action) AS best_action FROM q) """


@query("policy_rewards", _REWARDS + "SELECT state, action, round(mean_reward, 6) AS mean_reward, n, best_action FROM b")
def policy_rewards(spark, sf):
    return rounded(series.policy_rewards(_states(spark, sf)), 6)


@query(
    "policy_trace",
    _REWARDS
    + f""", w AS (SELECT segment, month, st.state, best_action, nr * 100 * gain - vol * 100 * cost AS reward FROM st JOIN b ON b.state = st.state AND b.action = b.best_action
 JOIN a ON a.action = b.best_action WHERE has_next)
 SELECT segment, {MONTH}, state, best_action, round(reward, 4) AS reward, round(sum(reward) {OVER}, 4) AS cumulative_reward FROM w""",
)
def policy_trace(spark, sf):
    traced = series.policy_trace(_states(spark, sf), "month", SEGMENT, grain="month")
    return rounded(traced.select("segment", day("month").alias("month"), "state", "best_action", "reward", "cumulative_reward"))
