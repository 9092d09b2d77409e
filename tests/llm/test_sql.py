import duckdb
import pytest

from huntframe.llm.queries import LLM_QUERIES, LLM_SQL

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(LLM_SQL))
def test_query_equals_its_sql(spark, name):
    tables = duckdb.connect()
    for table in ("documents", "benchmark"):
        tables.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    expected = tables.sql(LLM_SQL[name])
    found = LLM_QUERIES[name](spark, FOLDER)
    assert found.columns == expected.columns
    assert [t for _, t in found.dtypes] == [{"BIGINT": "bigint", "VARCHAR": "string", "BOOLEAN": "boolean"}[str(t)] for t in expected.types]
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected.fetchall())
