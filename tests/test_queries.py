"""Every registered link-graph query against its SQL."""

import pytest
from oracle import connect, same_rows

from linkloom.plans import registry


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, con, name):
    rows = registry.QUERIES[name](spark, data).toPandas()
    if name in registry.ORACLE_SQL:
        same_rows(rows, con.execute(registry.ORACLE_SQL[name]).df())
    else:
        assert len(rows)


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
