"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tests.oracle import compare, connect

CHECKS = contract.oracle_sql()
QUERIES = contract.queries()
# Checked by their own invariants elsewhere, or the same code as another query with larger settings.
SLOW = {"evaluate_all_models", "evaluate_classifiers", "compare_unsupervised", "param_grid", "report_facts", "direct_forecast"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_same_rows_as_sql(spark, sf, con, name):
    assert compare(con, QUERIES[name](spark, sf), CHECKS[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS) - SLOW))
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_and_names(spark):
    assert contract.entry(spark).count() > 0
    assert set(CHECKS) <= set(QUERIES)
