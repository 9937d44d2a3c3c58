"""Registered queries against their SQL on the smallest tables, and the driver's contract."""

import pytest
from check_oracle import compare, database

import __spark_entry__ as contract
from quantspan.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def con():
    return database(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.oracle_sql())


def test_entry_has_a_row(spark):
    assert contract.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    verdict, _ = compare(contract.queries()[name](spark, SF), con, contract.oracle_sql()[name])
    assert verdict == "ok"
