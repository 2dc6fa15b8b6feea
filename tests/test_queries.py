"""Every registered query against its SQL on the smallest tables, over whole results."""

import pytest

import __spark_entry__ as contract
from compare import compare, connect
from pagelattice.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    outcome = compare(spark, con, name, FOLDER)
    assert outcome.startswith("ok"), outcome


def test_every_query_has_sql():
    assert set(QUERIES) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
