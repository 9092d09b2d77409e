"""Every registered query against its SQL twin on the small tables."""

import pytest

from huntframe.queries.catalog import QUERIES, SQL
from oracle import compare, connect


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, folder, name):
    df = QUERIES[name](spark, folder)
    if name in SQL:
        assert compare(df, con, SQL[name]) in (None, "both empty")
    else:
        assert df.collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["user_id", "ts", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
