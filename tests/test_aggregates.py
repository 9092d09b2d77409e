import random
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plans import plan_of
from huntframe.operators.aggregates import (
    arg_max, arg_min, avg, count, dcount, distinct_items, listed_items, make_list, make_set, maximum, minimum,
    percentile, stdev, summarize, total, variance,
)
from huntframe.operators.skew import exact_percentiles, hot_keys, rank_within


@pytest.fixture(scope="module")
def logons(spark):
    def at(h, m=0):
        return datetime(2024, 1, 1, h, m)
    return spark.createDataFrame([
        (1, "host1", at(1), "early.exe", "3"), (2, "host1", at(5), "latest.exe", "x"), (3, "host2", at(2), "only.exe", None),
        (4, "host1", at(5), "tied.exe", "4"), (5, None, at(3), "nohost.exe", "9"),
    ], "id long, host string, t timestamp, cmd string, n string")


def by_host(df):
    return {r.host: r for r in df.collect()}


def test_plain_aggregates_and_null_group(logons):
    got = by_host(summarize(logons, ["host"], n_rows=count("n"), s=total("n"), a=avg("n"), lo=minimum("cmd"),
                            hi=maximum("cmd"), d=dcount("cmd")))
    assert set(got) == {"host1", "host2", None}
    assert (got["host1"].n_rows, got["host1"].s, got["host1"].a, got["host1"].d) == (3, 7.0, 3.5, 3)
    assert (got["host2"].n_rows, got["host2"].s, got["host2"].a) == (1, 0.0, None)


def test_spread_of_one_row_is_null(logons):
    got = by_host(summarize(logons, ["host"], sd=stdev("n"), var=variance("n")))
    assert got["host1"].sd == pytest.approx(np.std([3, 4], ddof=1)) and got["host2"].sd is None
    assert got["host1"].var == pytest.approx(0.5)


def test_time_bin_kept_or_dropped(logons):
    kept = summarize(logons, ["host"], every="PT2H", time="t", n=count())
    assert kept.columns == ["host", "t", "n"] and kept.count() == 4
    assert summarize(logons, ["host"], every="PT2H", time="t", keep_bin=False, n=count()).columns == ["host", "n"]


def test_multi_day_bins_follow_the_origin(spark):
    df = spark.createDataFrame([(datetime(2026, 6, 24),), (datetime(2026, 6, 23, 23),)], "t timestamp")
    by_epoch = {r.t for r in summarize(df, every="P14D", time="t", n=count()).collect()}
    by_origin = {r.t for r in summarize(df, every="P14D", time="t", origin=datetime(2026, 6, 24), n=count()).collect()}
    assert by_epoch == {datetime(2026, 6, 18)}
    assert by_origin == {datetime(2026, 6, 10), datetime(2026, 6, 24)}


def test_null_time_is_its_own_bin(spark):
    df = spark.createDataFrame([(None,), (datetime(2024, 1, 1),)], "t timestamp")
    assert {r.t: r.n for r in summarize(df, every="P1D", time="t", n=count()).collect()} == {
        None: 1, datetime(2024, 1, 1): 1}


def test_global_aggregate_of_nothing_is_no_row(logons):
    empty = logons.filter("id < 0")
    assert summarize(empty, n=count()).count() == 0
    assert summarize(empty, p=percentile("n", 50), s=make_set("cmd")).count() == 0
    assert summarize(logons, n=count()).first().n == 5


def test_distinct_keys_only(logons):
    assert summarize(logons, ["host"]).count() == 3


def test_sets_and_lists_keep_order_and_drop_nulls(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 3, "y"), ("a", 4, "x"), ("b", 1, None)],
                               "k string, t int, v string")
    got = {r.k: r for r in summarize(df, ["k"], s=make_set("v", order=("t",)), l=make_list("v", order=("t",)),
                                     s1=make_set("v", 1, ("t",)), l2=make_list("v", 2, ("t",))).collect()}
    assert (got["a"].s, got["a"].l, got["a"].s1, got["a"].l2) == (["x", "y"], ["x", "y", "x"], ["x"], ["x", "y"])
    assert (got["b"].s, got["b"].l) == ([], [])
    overall = summarize(df, s=make_set("v", 1, ("t", "k"))).first()
    assert overall.s == ["x"]


def test_large_limit_and_long_form(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), "id", F.timestamp_seconds("id").alias("t"))
    rows = {r.k: r.l for r in summarize(df, ["k"], l=make_list("id", 1500, ("id",))).collect()}
    assert rows[0] == list(range(0, 3000, 2))
    long = listed_items(df, ["k"], "id", ["t", "id"], "t", "PT10M").filter("k = 1").orderBy("position").collect()
    assert [r.id for r in long] == list(range(1, 5000, 2)) and [r.position for r in long] == list(range(1, 2501))
    assert distinct_items(df, ["k"], "id").count() == 5000


def test_arg_max_all_columns_and_ties(logons):
    got = by_host(summarize(logons, ["host"], picks=(arg_max("t", "*", first="id"),)))
    assert got["host1"].cmd == "latest.exe" and got["host2"].cmd == "only.exe" and len(got) == 3


def test_arg_min_and_alias(logons):
    got = by_host(summarize(logons, ["host"], n=count(), picks=(
        arg_min("t", "cmd", alias="First"), arg_max("t", "id", alias="Last", first="id"))))
    assert got["host1"].cmd == "early.exe" and got["host1"].id == 2 and got["host1"].n == 3
    assert "t" not in got["host1"].asDict()


def test_arg_max_skips_null_order(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("b", None, 3)], "k string, o int, v int")
    got = {r.k: r.v for r in summarize(df, ["k"], picks=(arg_max("o", "v"),)).collect()}
    assert got == {"a": 2, "b": None}


@pytest.mark.parametrize("seed", range(4))
def test_percentile_against_pandas(spark, seed):
    rng = random.Random(seed)
    # One key holds most rows; values repeat, and some are missing or not a number.
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abcd"),
             rng.choice([None, float("nan"), float(rng.randint(0, 50)), rng.gauss(0, 100)])) for _ in range(800)]
    rows += [("none", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    points = {"p0": 0, "p5": 5, "p50": 50, "p95": 95, "p100": 100}
    got = {r.k: r for r in summarize(df, ["k"], n=count(), **{a: percentile("v", p) for a, p in points.items()}).collect()}
    frame = pd.DataFrame(rows, columns=["k", "v"])
    for key, part in frame.groupby("k", dropna=False):
        key = None if pd.isna(key) else key
        for alias, p in points.items():
            expected = part["v"].quantile(p / 100)
            assert got[key][alias] == (None if pd.isna(expected) else pytest.approx(expected))


def test_percentile_never_gathers_a_group(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    plan = plan_of(exact_percentiles(events, ["event_type"], F.col("value"), {"p": 95}))
    assert "collect_list" not in plan and " percentile(" not in plan


@pytest.mark.parametrize("seed", range(3))
def test_rank_within_against_pandas(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 5 + ["a", None]), i, rng.randint(0, 99)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, id int, v int")
    got = {r.id: (r.rank, r.rank_of) for r in rank_within(df, ["k"], [F.col("v"), F.col("id")], F.floor(F.col("v") / 10)).collect()}
    frame = pd.DataFrame(rows, columns=["k", "id", "v"]).sort_values(["v", "id"])
    grouped = frame.groupby("k", dropna=False)
    frame["r"], frame["n"] = grouped.cumcount() + 1, grouped["id"].transform("size")
    assert got == {r.id: (r.r, r.n) for r in frame.itertuples()}


def test_hot_keys(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"))
    assert [r.k for r in hot_keys(df, ["k"]).collect()] == [0]


def test_top_rows_of_a_group_are_cut_before_the_shuffle(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    plan = plan_of(summarize(events, ["event_type"], l=make_list("event_id", 5, ("ts", "event_id"))))
    assert "WindowGroupLimit" in plan
