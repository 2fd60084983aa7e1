"""Every registered query against its SQL on the small data set."""

import pytest

from assayer.plans import compare, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return compare.duckdb_connection(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, connection, name):
    result = compare.compare(spark, connection, registry.queries()[name], registry.oracles().get(name), SF)
    assert result["match"] is not False, result


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracles())
