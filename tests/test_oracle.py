"""Registered queries against their DuckDB SQL on the smallest scale factor."""

import pytest

from conftest import SF001


def _names():
    from seqflip.plans.registry import oracle_sql
    return sorted(oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_query_matches_duckdb(spark, name):
    from check_oracle import compare, duck
    ok, msg = compare(spark, duck(SF001), name, SF001)
    assert ok, msg


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() >= 0 and "status" in df.columns
