from datetime import datetime, timedelta

import pytest
from plans import plan_of
from pyspark.sql import functions as F

from huntframe.operators.sketches import (
    distinct_estimate, merge_sketches, new_values, quantile_estimate, sketch_by_period, write_sketches,
)

DAY = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    rows = [(i, "ab"[i % 7 == 0], DAY + timedelta(hours=i % 240), f"u{i % 5000}" if i % 11 else None, float(i * 37 % 10_007) if i % 13 else None) for i in range(20_000)]
    return spark.createDataFrame(rows + [(-1, "c", None, "x", 1.0), (-2, "d", DAY, None, float("nan"))], "id int, k string, at timestamp_ntz, who string, x double")


def test_merged_days_are_near_the_exact_values(spark, events, tmp_path):
    path = str(tmp_path / "s")
    write_sketches(sketch_by_period(events, ["k"], "at", ["who"], ["x"]), path)
    stored = spark.read.parquet(path)
    start, stop = DAY + timedelta(days=2), DAY + timedelta(days=7)
    merged = merge_sketches(stored, ["k"], start, stop)
    assert "PartitionFilters: [isnotnull(sketch_day" in plan_of(merged)
    got = {r.k: r for r in merged.select("k", "rows", distinct_estimate("who_distinct").alias("n"), quantile_estimate("x_quantiles", 50).alias("m")).collect()}
    exact = events.filter((F.col("at") >= start) & (F.col("at") < stop)).groupBy("k").agg(
        F.count("*").alias("rows"), F.count_distinct("who").alias("n"), F.percentile("x", 0.49).alias("lo"), F.percentile("x", 0.51).alias("hi")).collect()
    assert {r.k for r in exact} == set(got) == {"a", "b"}
    for r in exact:
        assert got[r.k].rows == r.rows and abs(got[r.k].n - r.n) <= 0.03 * r.n and r.lo <= got[r.k].m <= r.hi


def test_new_values_and_nothing_at_all(spark, events):
    days = sketch_by_period(events, ["k"], "at", ["who", "id"], ["x"])
    split = DAY + timedelta(days=5)
    got = {r.k: r for r in new_values(days, ["k"], "id", split).collect()}
    assert set(got) == {"a", "b", "d"}  # rows without a time take no part
    for k in "ab":
        for name, when in (("before", F.col("at") < split), ("after", F.col("at") >= split), ("fresh", F.col("at") >= split)):
            n = events.filter((F.col("k") == k) & when).count()
            assert abs(got[k][name] - n) <= 0.04 * 20_000
    assert (got["d"].before, got["d"].after, got["d"].fresh) == (1, 0, 0)
    empty = merge_sketches(days, ["k"]).filter("k = 'd'").select(
        "rows", distinct_estimate("who_distinct").alias("n"), quantile_estimate("x_quantiles", 50).alias("m")).first()
    assert tuple(empty) == (1, 0, None)
    assert merge_sketches(sketch_by_period(events.limit(0), ["k"], "at", ["who"], ["x"]), ["k"]).collect() == []
