"""The interval join against every pair, its hot cells and its plan."""

import datetime
import itertools
import math
import random

import pytest

from tablewright.operators import intervals
from tablewright.operators.intervals import interval_join
from tests.conftest import rows

INSIDE = {
    "both": lambda a, x, b: (a is None or a <= x) and (b is None or x <= b),
    "left": lambda a, x, b: (a is None or a <= x) and (b is None or x < b),
    "right": lambda a, x, b: (a is None or a < x) and (b is None or x <= b),
    "neither": lambda a, x, b: (a is None or a < x) and (b is None or x < b),
}


def spans_of(rng, place, n):
    out = []
    for i in range(n):
        a, b = sorted((place(), place()))
        out.append((i, rng.choice([a, a, a, None]), rng.choice([b, b, b, a, None]), rng.choice(["x", "y", None])))
    return out


@pytest.mark.parametrize("closed", sorted(INSIDE))
@pytest.mark.parametrize("kind", ["long", "double", "date", "timestamp_ntz", "timestamp"])
def test_equals_every_pair(spark, closed, kind):
    rng = random.Random(f"{closed}{kind}")
    day = datetime.datetime(1999, 12, 28)
    utc = datetime.UTC if kind == "timestamp" else None
    place = {
        "long": lambda: rng.choice([rng.randrange(-50, 50), rng.randrange(-(2**63), 2**63), 0]),
        "double": lambda: rng.choice([rng.uniform(-5, 5), rng.uniform(-1e30, 1e30), math.inf, -math.inf, 0.0]),
        "date": lambda: (day + datetime.timedelta(rng.randrange(-400, 400))).date(),
        "timestamp_ntz": lambda: day + datetime.timedelta(microseconds=rng.randrange(-(10**14), 10**14)),
        "timestamp": lambda: (day + datetime.timedelta(seconds=rng.randrange(-(10**8), 10**8))).replace(tzinfo=utc),
    }[kind]
    points = [(i, rng.choice([place(), place(), place(), None]), rng.choice(["x", "y", None])) for i in range(60)]
    points += [(i, x, k) for (i, _, k), (_, x, _, _) in zip(points, spans_of(rng, place, 40), strict=False)]
    spans = spans_of(rng, place, 40)
    left = spark.createDataFrame(points, f"id long, at {kind}, k string")
    right = spark.createDataFrame(spans, f"id long, a {kind}, b {kind}, k string")
    inside = INSIDE[closed]
    want = sorted((p, s) for p, x, _ in points if x is not None for s, a, b, _ in spans if (a is None or b is None or a <= b) and inside(a, x, b))
    got = interval_join(left, right, "at", "a", "b", closed=closed)
    assert got.columns == ["id", "at", "k", "id_interval", "a", "b", "k_interval"]
    assert rows(got.select("id", "id_interval"), "id", "id_interval") == want
    keyed = sorted((p, s) for p, x, k in points if x is not None for s, a, b, of in spans if k and k == of and (a is None or b is None or a <= b) and inside(a, x, b))
    got = interval_join(left, right, "at", "a", "b", ["k"], closed, hot_rows=2)
    assert got.columns == ["id", "at", "k", "id_interval", "a", "b"]
    assert rows(got.select("id", "id_interval"), "id", "id_interval") == keyed


def test_hot_cell_is_dealt_and_repeats_count(spark):
    left = spark.createDataFrame([(7,)] * 500 + [(None,), (8,)], "at int")
    right = spark.createDataFrame([(5, 9, "a"), (5, 9, "a"), (9, 5, "backwards"), (8, 8, "b")], "lo int, hi int, name string")
    got = interval_join(left, right, "at", "lo", "hi", hot_rows=20)
    assert rows(got.groupBy("at", "name").count(), "at", "name") == [(7, "a", 1000), (8, "a", 2), (8, "b", 1)]
    tree = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in tree


def test_no_pairs_without_a_cell_and_odd_input(spark):
    left = spark.createDataFrame([(1.5,), (float("nan"),)], "at double")
    right = spark.createDataFrame([(1.0, 2.0), (float("nan"), 2.0), (None, None)], "lo double, hi double")
    got = interval_join(left, right, "at", "lo", "hi")
    assert rows(got, "lo") == [(1.5, None, None), (1.5, 1.0, 2.0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert interval_join(left, right.limit(0), "at", "lo", "hi").count() == 0
    assert interval_join(left.limit(0), right, "at", "lo", "hi").count() == 0
    with pytest.raises(TypeError):
        interval_join(left.selectExpr("cast(at as float) at"), right, "at", "lo", "hi")
    with pytest.raises(ValueError):
        interval_join(left, right, "at", "lo", "hi", closed="open")


def test_levels_share_cells_where_that_makes_fewer_copies():
    many = {37: 10, 38: 10, 39: 20, 40: 40, 41: 80, 42: 160, 43: 170}
    bases = intervals.base_levels(many, 1000)
    assert bases.keys() == many.keys() and all(bases[v] <= v for v in many) and len(set(bases.values())) < 4
    cost = lambda b, rows: rows * len(set(b.values())) + sum(n * (2 << (v - b[v])) for v, n in many.items())
    kept = [[37, *c] for n in range(7) for c in itertools.combinations(range(38, 44), n)]
    every = [cost({v: max(b for b in k if b <= v) for v in many}, 1000) for k in kept]
    assert cost(bases, 1000) == min(every) < cost({v: v for v in many}, 1000)
    assert intervals.base_levels(many, 1) == {v: v for v in many}  # few rows: every interval keeps its own cells
    assert intervals.base_levels({}, 5) == {} and intervals.base_levels({3: 1, 62: 1}, 1000) == {3: 3, 62: 62}
