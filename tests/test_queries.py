"""Every registered query against its SQL on the smallest tables."""

import os

import oracle
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, connection, name):
    problem = oracle.difference(spark, connection, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert problem is None


def test_entry_has_rows(spark):
    found = entry.entry(spark)
    assert set(found.columns) == {"key", "active", "hits", "visible"} and found.filter("visible").count() > 0
