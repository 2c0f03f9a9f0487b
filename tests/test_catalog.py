"""Catalog queries against their SQL twins at the smallest size."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from bench import HEADLINE
from tests.oracle import compare, connect

DIR = "/root/testdata/sf0.001"
# the whole catalog takes several minutes: ALL_QUERIES=1 here, or python -m tests.oracle
NAMES = sorted(entry.oracle_sql() if os.environ.get("ALL_QUERIES") else set(HEADLINE) & set(entry.oracle_sql()))


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    rows, ok, _, note = compare(spark, con, DIR, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_catalog_loads_without_a_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0], timeout=120)


def test_entry(spark):
    assert entry.entry(spark).count() == 25 * 2 * 168
