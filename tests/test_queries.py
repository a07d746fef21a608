"""Every query with SQL gives its rows on the smallest data; every other one runs."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import duck, same

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.catalog.QUERIES, entry.catalog.ORACLE
#: Queries without rows on the smallest data.
EMPTY: set[str] = set()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert same(spark, con, FOLDER, QUERIES[name], SQL[name]) in ("", "empty" if name in EMPTY else "")
    else:
        QUERIES[name](spark, FOLDER).collect()


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(SQL) <= set(QUERIES)
