"""Every query of the usage engine against its SQL, on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entry
from meterlake.checks.oracle import oracle_sql
from meterlake.checks.queries import queries
from tests.compare import differences, oracle_connection

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def oracle():
    con = oracle_connection(SF_DIR)
    yield con
    con.close()


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())
    assert set(queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0
    assert rows.columns[:3] == ["series", "day", "cost"]


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, oracle, name):
    rows = queries()[name](spark, SF_DIR)
    assert differences(rows, oracle, oracle_sql()[name]) == []
