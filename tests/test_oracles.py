"""Every registered query against its SQL twin."""

import pytest
from oracle import compare, connect

from tracetide.plans.registry import registry

QUERIES = registry()


@pytest.fixture(scope="module")
def con(sf_dir):
    pytest.importorskip("duckdb")
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    query, sql = QUERIES[name]
    df = query(spark, sf_dir)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, con, sql) == []


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 9
    assert set(entry.oracle_sql()) <= set(entry.queries())
