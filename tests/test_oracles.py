"""Every registered query against its SQL oracle on the smallest driver tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from playbill.plans import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    rows, problem = compare(spark, con, SF, name)
    assert problem is None
    assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 4
