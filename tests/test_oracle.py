"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from tests.support import compare

SQL = entry.oracle_sql()


@pytest.mark.parametrize("key", list(entry.queries()))
def test_query_equals_sql(spark, con, sf_dir, key):
    problem, *_ = compare(spark, con, key, entry.queries()[key], SQL.get(key), sf_dir)
    assert problem == ""


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())
