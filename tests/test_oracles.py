"""Every registered query against its DuckDB text on the smallest tables."""

import pytest
from oracle_check import connect, duck_rows, mismatch, spark_rows

import __spark_entry__ as driver

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query_matches_oracle(spark, duck, name):
    got = spark_rows(driver.queries()[name](spark, SF_DIR))
    oracle = driver.oracle_sql().get(name)
    if oracle is not None:
        assert mismatch(got, duck_rows(duck, oracle)) is None


def test_entry(spark):
    assert driver.entry(spark).limit(1).count() == 1
