"""Every registered query that has SQL gives the same columns and values; the others run."""

import pytest
from oracle import compare

from quillframe import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, sf, con, name):
    compare(registry.QUERIES[name](spark, sf), con, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
