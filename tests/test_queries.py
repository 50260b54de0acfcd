"""Registered queries against their SQL at the smallest scale.

Whole plans on drawn dials take minutes together; they run with KONGRID_ALL=1.
"""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import check, duck

SLOW = ("pl1", "pl5", "al1", "al3", "al4", "al5", "al6", "ag7_refine", "ag8", "ag10", "nb10", "pl2")
NAMES = [n for n in entry.oracle_sql() if os.environ.get("KONGRID_ALL") or not n.startswith(SLOW)]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, con, name):
    ok, _, _, note = check(spark, con, sf, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
