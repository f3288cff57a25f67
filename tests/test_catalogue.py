import pytest

from engram import catalogue

from .oracle import assert_same

#: Results that are empty on the smallest tables.
MAY_BE_EMPTY = {"discover_connections"}


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, data, name):
    n = assert_same(catalogue.QUERIES[name](spark, data), catalogue.ORACLE_SQL[name], data)
    assert n or name in MAY_BE_EMPTY


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
