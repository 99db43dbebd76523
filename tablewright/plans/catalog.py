"""All queries of the library."""

from __future__ import annotations

from tablewright.plans import cubes, live, modelling, outlook, profiling, repair, scoring, tables, timeline  # noqa: F401
from tablewright.plans.registry import CHECKS, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def checks() -> dict[str, str]:
    return dict(CHECKS)


def flagship(spark, folder):
    return QUERIES["period_compare"](spark, folder)
