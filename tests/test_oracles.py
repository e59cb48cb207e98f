"""Every registered query against its independent DuckDB SQL (sf0.001)."""

import pytest

from tests.conftest import SF_SMALL
from tidewater.registry import all_oracles, all_queries
from tidewater.verify.compare import compare, duckdb_connection

QUERIES = all_queries()
ORACLES = all_oracles()


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(QUERIES[name](spark, SF_SMALL), con, ORACLES[name])
    assert res["schema_match"], res
    assert res["rows_match"], res
    assert res["values_match"], res


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "most_common_grade" in df.columns
