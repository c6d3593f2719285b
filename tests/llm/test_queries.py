"""Registered queries of the subpackage that have SQL, against DuckDB; and the names and columns of all."""

import pytest

from conftest import SF001
from seqflip.llm import queries as Q


@pytest.mark.parametrize("sf_dir", [SF001, "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_duckdb(spark, name, sf_dir):
    from check_oracle import compare, duck

    ok, msg = compare(spark, duck(sf_dir), name, sf_dir)
    assert ok, msg


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in Q.queries())
    assert numbers == list(range(1, 14))
