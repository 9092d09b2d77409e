"""Named queries over the provided tables, each with an equivalent SQL text where there is one."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.session import pin_utc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

AS_OF = datetime(2024, 1, 31)
MONTH_START = datetime(2024, 1, 1)


class Tables:
    """Tables of one data folder, by attribute: ``Tables(spark, folder).events``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = pin_utc(spark), folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of ``Tables`` under a name, with its SQL twin."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return build

    return register


# A rule corpus derived from ``documents``. The expressions read the same in both SQL dialects.
RULE_COLUMNS = {
    "rule_id": "concat('r', cast(doc_id AS string))",
    "source_file": "concat(source, '/', cast(doc_id AS string), '.yaml')",
    "description_raw": """CASE WHEN n_chars % 11 = 0 THEN 'too short'
        WHEN n_chars % 13 = 0 THEN concat('{{name}} ', text)
        WHEN n_chars % 17 = 0 THEN concat('Deprecated: ', text) ELSE text END""",
    "query": """concat(
        CASE lang WHEN 'en' THEN 'imAuthentication' WHEN 'fr' THEN '_Im_Dns'
                  WHEN 'de' THEN 'ASimNetworkSession' ELSE 'SecurityEvent' END,
        repeat(concat(' | where EventResult == "', source, '"'), cast(n_chars % 7 AS int)),
        CASE WHEN n_chars % 10 = 0 THEN ' | join kind=inner (imDns) on SrcIpAddr' ELSE '' END,
        CASE WHEN n_chars % 3 = 0 THEN ' | summarize Total = count() by SrcIpAddr' ELSE '' END,
        CASE WHEN n_chars % 6 = 0 THEN ', bin(TimeGenerated, 1h)' ELSE '' END,
        CASE WHEN n_chars % 12 = 0 THEN ', DvcHostname' ELSE '' END,
        CASE WHEN n_chars % 3 = 0 THEN ' | where Total > 5' ELSE '' END,
        CASE WHEN n_chars % 5 = 0 THEN ' | extend Mystery = Unheard' ELSE '' END)""",
}


def rules(t: Tables) -> DataFrame:
    return t.documents.selectExpr(*[f"{e} AS {c}" for c, e in RULE_COLUMNS.items()], "lang", "source")


RULES_SQL = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in RULE_COLUMNS.items()) + \
    ", lang, source FROM documents)"


def address(expr: str = "c_custkey") -> str:
    """An IPv4 address derived from a number, some of them private; same text in both dialects."""
    k = expr
    return f"""concat(CASE WHEN {k} % 4 = 0 THEN '10.' WHEN {k} % 4 = 1 THEN '172.'
        WHEN {k} % 4 = 2 THEN '192.' ELSE '8.' END,
        CASE WHEN {k} % 4 = 2 THEN '168' ELSE cast({k} % 32 AS string) END, '.',
        cast({k} % 256 AS string), '.', cast({k} % 250 AS string))"""


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def joined(df: DataFrame, *columns: str) -> DataFrame:
    """Array columns as comma-separated text, for comparison across engines."""
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in columns})
