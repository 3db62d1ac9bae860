"""Every registered query beside its SQL check on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from estatelens.cases.catalog import all_cases
from tools.check_queries import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, CHECKS = all_cases().queries, all_cases().checks

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not there")


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_check(spark, db, name):
    ok, note = compare(spark, db, name, SF)
    assert ok, note


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


def test_the_entry_module_offers_them_all():
    assert set(QUERIES) <= set(entry.queries())
    assert set(CHECKS) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "effort_md" in df.columns
