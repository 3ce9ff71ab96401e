import os

import pytest
from oracle_compare import compare, connection

from __spark_entry__ import entry
from workloads.oracle import ORACLE
from workloads.spark_queries import QUERIES

FOLDER = os.environ.get("QUERY_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLE[name]) is None
