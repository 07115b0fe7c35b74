"""Queries that SQL can express, against DuckDB."""

import pytest

from scanweave.llm import queries
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf_dir, name):
    same(connect(sf_dir), queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name])


def test_all_are_there():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)}
