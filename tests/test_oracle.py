"""The correctness gate inside the suite: every registered query against its
DuckDB formulation on sf0.001 (row count, columns, types, values)."""

import pytest

import __spark_entry__ as E

from .conftest import SF001
from .oracle_check import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("key", sorted(E.queries()))
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, con, SF001, key, E.queries()[key], E.oracle_sql().get(key))
    assert r["status"] in ("ok", "rows-only"), r
    if key in E.oracle_sql():
        assert r["status"] == "ok"
