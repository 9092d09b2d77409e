"""Random chains of operators against DuckDB, seeded."""

import random

import pytest
from pyspark.sql import functions as F

from huntframe.functions import predicates as P
from huntframe.operators import aggregates as A
from huntframe.operators.joins import join
from huntframe.operators.stages import extend, top, where
from oracle import compare, connect

FILTERS = [
    (lambda: P.eq("event_type", "error"), "event_type = 'error'"),
    (lambda: P.not_in("event_type", ["view", "click"]), "event_type NOT IN ('view', 'click')"),
    (lambda: P.gt("value", 20), "value > 20"),
    (lambda: P.any_of(P.lt("value", 5), P.startswith("event_type", "SIGN")), "(value < 5 OR starts_with(event_type, 'sign'))"),
    (lambda: P.not_contains("props", ": 1"), "NOT contains(props, ': 1')"),
    (lambda: P.has_any("props", ["7", "42"]), "regexp_matches(props, '(^|[^A-Za-z0-9_])(7|42)($|[^A-Za-z0-9_])')"),
    (lambda: P.le("user_id", 9), "user_id <= 9"),
]
AGGREGATES = {
    "n": (A.count, "count(*)"), "s": (lambda: A.total("value"), "coalesce(sum(value), 0)"),
    "d": (lambda: A.dcount("event_type"), "count(DISTINCT event_type)"), "hi": (lambda: A.maximum("ts"), "max(ts)"),
    "p": (lambda: A.percentile("value", 75), "quantile_cont(value, 0.75)"), "sd": (lambda: A.stdev("value"), "stddev_samp(value)"),
}
KEYS = ["user_id", "event_type", "props"]


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("seed", range(16))
def test_chain(spark, con, folder, seed):
    rng = random.Random(seed)
    df, sql = spark.read.parquet(f"{folder}/events.parquet"), "SELECT * FROM events"
    if rng.random() < 0.5:
        df, sql = extend(df, value=F.col("value") * 2), f"SELECT * REPLACE (value * 2 AS value) FROM ({sql})"
    chosen = rng.sample(FILTERS, rng.randint(0, 2))
    df = where(df, *[test() for test, _ in chosen])
    sql = f"SELECT * FROM ({sql}) WHERE {' AND '.join(c for _, c in chosen) or 'true'}"
    if rng.random() < 0.4:
        side = spark.read.parquet(f"{folder}/customer.parquet").filter("c_acctbal > 3000").select(F.col("c_custkey").alias("user_id"))
        kind = rng.choice(["leftsemi", "leftanti"])
        df = join(df, side, "user_id", kind, salts=rng.choice([0, 4]))
        sql = f"SELECT * FROM ({sql}) WHERE user_id {'' if kind == 'leftsemi' else 'NOT'} IN (SELECT c_custkey FROM customer WHERE c_acctbal > 3000)"
    keys = rng.sample(KEYS, rng.randint(0, 2))
    every = rng.choice([None, ("PT6H", "6 hours"), ("P1D", "1 day")])
    names = rng.sample(sorted(AGGREGATES), rng.randint(1, 3))
    df = A.summarize(df, keys, every=every and every[0], time="ts", **{n: AGGREGATES[n][0]() for n in names})
    parts = keys + ([f"time_bucket(INTERVAL '{every[1]}', ts)"] if every else [])
    shown = keys + ([f"{parts[-1]} AS ts"] if every else []) + [f"{AGGREGATES[n][1]} AS {n}" for n in names]
    sql = f"SELECT {', '.join(shown)} FROM ({sql}) {'GROUP BY ' + ', '.join(parts) if parts else 'HAVING count(*) > 0'}"
    if keys and rng.random() < 0.5:
        order = tuple(keys) + (("ts",) if every else ())
        df = top(df, 7, names[0], tiebreak=order)
        sql = f"SELECT * FROM ({sql}) ORDER BY {names[0]} DESC NULLS LAST, {', '.join(order)} LIMIT 7"
    assert compare(df, con, sql) in (None, "both empty"), sql
