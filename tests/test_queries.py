"""Every registered query against its SQL oracle on the same tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from scoremon.plans import catalog
from tests.conftest import SF_CHECK
from tests.oracle_check import compare, connect

# The training-data operators have their own tests in tests/llm.
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_CHECK)


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    ok, note = compare(QUERIES[name](spark, SF_CHECK), con, ORACLES[name])
    assert ok, note
