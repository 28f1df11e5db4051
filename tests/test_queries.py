"""Every query runs; those with a SQL twin give the same rows."""

import os

import pytest

from pagewright.plans.registry import all_queries

from . import oracle

FOLDER = "/root/testdata/sf0.001"
QUERIES = all_queries()


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    ok, note = oracle.compare(spark, db, QUERIES[name], FOLDER)
    assert ok, note
