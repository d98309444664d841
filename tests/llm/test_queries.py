"""Queries with SQL against DuckDB; the others run."""

import pytest

from corpuskit.llm.queries import registry
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(registry.sql))
def test_equals_sql(spark, data, name):
    assert_same(spark, data, registry.queries[name], registry.sql[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries) - set(registry.sql)))
def test_runs(spark, data, name):
    assert registry.queries[name](spark, data).count() > 0
