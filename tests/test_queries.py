"""Every registered query of the library's own operators against its SQL, on the smallest tables."""

import pytest

from cohortframe.plans import registry

from .oracle import compare

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    compare(spark, name, FOLDER, QUERIES, SQL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
