"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    difference = compare(spark, con, sf_dir, name)
    if difference == "no rows on either side":
        larger = "/root/testdata/sf0.01"
        difference = compare(spark, connect(larger), larger, name)
    assert difference is None


def test_registries_fit_together():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
