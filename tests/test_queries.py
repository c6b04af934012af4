from __future__ import annotations

import pytest

import __spark_entry__ as driver
from ledgerlens.queries.catalog import QUERIES
from ledgerlens.queries.oracle import ORACLE
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_its_sql():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert driver.entry(spark).count() == 200


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    assert difference(driver.queries()[name](spark, SF), duck, driver.oracle_sql()[name]) is None
