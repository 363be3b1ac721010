"""Every registered query of the engine against its SQL."""

import pytest

from cardinia import catalogue
from tests.oracle import SMALL, assert_same, connection


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    assert_same(catalogue.QUERIES[name](spark, SMALL), catalogue.ORACLE_SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_without_sql_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0


def test_flagship(spark):
    (row,) = catalogue.flagship(spark, SMALL).collect()
    assert row.cardinality > 0 and 1 <= row.q_error < 2


def test_entry_points_import():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
