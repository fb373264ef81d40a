"""Every query against its SQL twin over the smallest data set."""

import pytest
from compare import compare, duck
from conftest import DATA

import __spark_entry__ as driver
from rosterlake.plans.catalog import QUERIES
from rosterlake.plans.oracle import ORACLE


@pytest.fixture(scope="module")
def connection():
    return duck(DATA)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLE) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_sql(spark, connection, name):
    assert compare(spark, connection, DATA, name, QUERIES, ORACLE) == ""


def test_entry(spark):
    assert driver.entry(spark).count() == 25
