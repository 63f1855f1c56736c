"""The operators' queries against their SQL, on the smallest driver tables."""

import os

import pytest

from meterlake.llm.oracle import ORACLE
from meterlake.llm.queries import QUERIES
from tests.compare import differences, oracle_connection

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = oracle_connection(SF_DIR)
    assert differences(QUERIES[name](spark, SF_DIR), con, ORACLE[name]) == []
    con.close()
