"""One key holds a third of all rows: results stay whole and agree with DuckDB."""

import pytest
from pyspark.sql import functions as F

from huntframe.functions.predicates import eq
from huntframe.operators.aggregates import count, dcount, listed_items, make_set, percentile, summarize
from huntframe.operators.joins import followed_by, join
from huntframe.operators.skew import hot_keys
from oracle import compare, connect

SKEWED = "(SELECT CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS k, * FROM events)"


@pytest.fixture(scope="module")
def con():
    return connect("/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def events(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    return df.withColumn("k", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")))


def test_the_hot_key_is_found(events):
    assert [r.k for r in hot_keys(events, ["k"]).collect()] == [-1]


@pytest.mark.parametrize("kind, how", [("inner", "JOIN"), ("leftouter", "LEFT JOIN"), ("fullouter", "FULL JOIN")])
def test_join(events, con, kind, how):
    right = events.filter("value > 100").groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 8")
    got = join(events.select("k", "event_id"), right, "k", kind, salts=8)
    assert compare(got, con, f"""SELECT k, event_id, n FROM {SKEWED} {how} (SELECT k, count(*) AS n FROM {SKEWED}
        WHERE value > 100 GROUP BY k HAVING count(*) > 8) USING (k)""") is None


def test_summary(events, con):
    got = summarize(events, ["k"], n=count(), d=dcount("props"), p=percentile("value", 99),
                    s=make_set("event_id", 3, ("ts", "event_id"))).withColumn("s", F.array_join(F.col("s").cast("array<string>"), ","))
    assert compare(got, con, f"""SELECT k, count(*) AS n, count(DISTINCT props) AS d, quantile_cont(value, 0.99) AS p,
        array_to_string(list_slice(list(event_id ORDER BY ts, event_id), 1, 3), ',') AS s FROM {SKEWED} GROUP BY k""") is None


def test_list_as_rows(events, con):
    got = listed_items(events, ["k"], "event_id", ["ts", "event_id"], "ts")
    assert compare(got, con, f"SELECT k, row_number() OVER (PARTITION BY k ORDER BY ts, event_id) AS position, event_id FROM {SKEWED}") is None


def test_ordered_events(events, con):
    got = followed_by(events, ["k"], "ts", eq("event_type", "error"), eq("event_type", "view"), "PT3H")
    assert compare(got.select("event_id", "earlier", "latest_first"), con, f"""SELECT b.event_id, count(*) AS earlier,
        max(a.ts) AS latest_first FROM {SKEWED} a JOIN {SKEWED} b ON a.k = b.k AND a.ts < b.ts AND a.ts >= b.ts - INTERVAL '3 hours'
        WHERE a.event_type = 'error' AND b.event_type = 'view' GROUP BY b.event_id""") is None


def test_running_totals(spark):
    import random

    from huntframe.operators.skew import running_totals

    rng = random.Random(4)
    rows = [(float(v) if v % 3 else v + 0.5, rng.randint(0, 9), 1) for v in rng.sample(range(-5000, 5000), 3000)]
    got = running_totals(spark.createDataFrame(rows, "v double, a long, b int"), "v", {"sa": "a", "place": "b"})
    assert got.columns == ["v", "a", "b", "sa", "place"]
    total, expected = 0, {}
    for place, (v, a, _) in enumerate(sorted(rows), 1):
        total += a
        expected[v] = (total, place)
    assert {r.v: (r.sa, r.place) for r in got.collect()} == expected
    assert running_totals(spark.createDataFrame([], "v int, a long"), "v", {"s": "a"}).count() == 0
