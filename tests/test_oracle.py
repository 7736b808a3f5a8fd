"""Every registered query against DuckDB on the same tables."""

from __future__ import annotations

import pytest
from oracle_check import differences, duckdb_tables

import __spark_entry__ as entry
from procflow.plans.oracle import ORACLE
from procflow.plans.registry import QUERIES


@pytest.fixture(scope="module")
def con(checked):
    return duckdb_tables(checked)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_duckdb(spark, checked, con, name):
    assert differences(QUERIES[name](spark, checked), con, ORACLE[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
