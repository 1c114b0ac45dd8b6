"""Every registered query against the SQL that gives the same rows; those without SQL must give rows."""

import pytest

from plotwright.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, data, same, name):
    got = registry.QUERIES[name](spark, data)
    if name in registry.SQL:
        assert same(got.toPandas()) == same(duck.sql(registry.SQL[name]).df())
    else:
        assert got.columns and got.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
