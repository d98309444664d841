"""Every query that has SQL gives the rows DuckDB gives on the small tables; the others run."""

import pytest

from corpuskit.plans import catalog
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, data, name):
    assert_same(spark, data, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, data, name):
    assert catalog.queries()[name](spark, data).count() >= 0
