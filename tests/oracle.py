"""Run registered queries next to their SQL twin in DuckDB and compare the results.

    python tests/oracle.py [name-prefix ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = """region nation customer supplier part orders lineitem events documents embeddings
    pages benchmark labels conversations""".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(picked, key=lambda r: tuple((v is None, str(v)) for v in r))


STRICT = bool(os.environ.get("STRICT"))  # compare floating point numbers to the last bit


def close(a, b) -> bool:
    if not STRICT and isinstance(a, float) and isinstance(b, (int, float)) and not isinstance(b, bool):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return type(a) is type(b) and a == b or STRICT and isinstance(a, float) and isinstance(b, int) and a == b


def compare(df, con, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    expected, actual = rows_of(names, found.fetchall()), rows_of(df.columns, df.collect())
    if len(expected) != len(actual):
        return f"{len(actual)} rows against {len(expected)}"
    for a, e in zip(actual, expected):
        if not all(close(x, y) for x, y in zip(a, e)):
            return f"{a} against {e}"
    return None if expected else "both empty"


def main(prefixes: list[str]) -> int:
    from huntframe.queries.catalog import QUERIES, SQL
    from huntframe.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for name, build in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        started = time.time()
        try:
            if name in SQL:
                problem = compare(build(spark, folder), con, SQL[name])
            else:
                problem = None if build(spark, folder).collect() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None and problem != "both empty"
        mark = "ok  " if problem is None else ("WARN" if problem == "both empty" else "FAIL")
        kind = "" if name in SQL else " (rows only)"
        print(f"{mark} {name}{kind} {time.time() - started:.2f}s {problem or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
