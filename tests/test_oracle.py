"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from oracle import TESTDATA, compare, connect

from __spark_entry__ import oracle_sql, queries

SF_DIR = os.environ.get("TEST_SF_DIR", f"{TESTDATA}/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    got = queries()[name](spark, SF_DIR).toPandas()
    sql = oracle_sql().get(name)
    if sql is None:
        assert got.columns.size > 0
    else:
        problem = compare(got, con.execute(sql).fetchdf())
        assert problem is None, problem
