"""Corpus queries against their SQL on the small data set."""

import pytest

from assayer.llm import queries
from assayer.plans import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    result = compare.compare(spark, compare.duckdb_connection(SF), queries.QUERIES[name], queries.ORACLES[name], SF)
    assert result["match"], result
