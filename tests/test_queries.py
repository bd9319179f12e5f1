"""Every query that has a SQL twin against it. The subpackage that can be taken away brings
queries without one; its own tests hold those against brute force."""

import pytest

import __spark_entry__ as contract
from compare import difference
from heatlens.checks.queries import QUERIES


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_matches_sql(spark, data_dir, name):
    assert difference(spark, contract.queries()[name], contract.oracle_sql()[name], data_dir) is None


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark, data_dir):
    found = contract.entry(spark)
    assert found.columns == ["key", "est"] and found.count() > 0
