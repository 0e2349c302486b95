"""Every registered query against its SQL (or at least for rows) on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import difference, duck

FOLDER = os.environ.get("TEXTLOOM_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    assert difference(spark, con, FOLDER, name, queries(), oracle_sql()) is None


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
