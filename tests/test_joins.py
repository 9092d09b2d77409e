import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plans import plan_of
from huntframe.functions.predicates import eq
from huntframe.operators.joins import KINDS, attach, followed_by, join, within_span

HOWS = {"inner": "inner", "leftouter": "left", "rightouter": "right", "fullouter": "outer"}


def frames(spark, seed):
    rng = random.Random(seed)
    left = [(rng.choice([1, 1, 1, 2, 3, 4, None]), i, f"l{i}") for i in range(120)]
    right = [(rng.choice([1, 2, 3, 5, 6, None]), i, f"r{i}") for i in range(15)]
    return left, right, spark.createDataFrame(left, "k int, lid int, v string"), spark.createDataFrame(right, "k int, rid int, v string")


def rows(df):
    return sorted((tuple(None if pd.isna(x) else x for x in r) for r in df), key=str)


@pytest.mark.parametrize("salts", [0, 5])
@pytest.mark.parametrize("kind", HOWS)
@pytest.mark.parametrize("seed", range(2))
def test_kinds_against_brute_force(spark, seed, kind, salts):
    left, right, a, b = frames(spark, seed)
    got = join(a, b, "k", kind, salts=salts).select("k", "lid", "v", "rid", "v_right").collect()
    pairs = [(l, r) for l in left for r in right if l[0] is not None and l[0] == r[0]]
    expected = [(l[0], l[1], l[2], r[1], r[2]) for l, r in pairs]
    if kind in ("leftouter", "fullouter"):
        expected += [(*l, None, None) for l in left if l not in [p[0] for p in pairs]]
    if kind in ("rightouter", "fullouter"):
        expected += [(r[0], None, None, r[1], r[2]) for r in right if r not in [p[1] for p in pairs]]
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("salts", [0, 5])
@pytest.mark.parametrize("kind", ["leftanti", "leftsemi", "rightanti", "rightsemi"])
def test_half_joins(spark, kind, salts):
    left, right, a, b = frames(spark, 7)
    keep, other = (left, right) if kind.startswith("left") else (right, left)
    members = {r[0] for r in other if r[0] is not None}
    expected = [r for r in keep if (r[0] in members) == kind.endswith("semi")]
    assert rows(join(a, b, "k", kind, salts=salts).collect()) == rows(expected)


@pytest.mark.parametrize("salts", [0, 5])
def test_null_keys_match_only_when_asked(spark, salts):
    left, right, a, b = frames(spark, 3)
    nulls = sum(l[0] is None for l in left) * sum(r[0] is None for r in right)
    assert join(a, b, "k", "inner", null_safe=True, salts=salts).count() - join(a, b, "k", "inner").count() == nulls
    semi = join(a, b, "k", "leftsemi", null_safe=True, salts=salts).count()
    assert semi - join(a, b, "k", "leftsemi").count() == sum(l[0] is None for l in left)
    full = join(a, b, "k", "fullouter", null_safe=True, salts=salts)
    assert full.filter("lid IS NULL").count() == sum(r[0] not in {l[0] for l in left} for r in right)


def test_innerunique_keeps_first_left_row_and_all_right_rows(spark):
    a = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")], "k int, o int, v string")
    b = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30)], "k int, w int")
    got = sorted((r.k, r.v, r.w) for r in join(a, b, "k", "innerunique", first=["o"]).collect())
    assert got == [(1, "a", 10), (1, "a", 11), (2, "c", 20)]


@pytest.mark.parametrize("salts", [0, 4])
def test_innerunique_with_a_frequent_right_key_and_maps(spark, salts):
    a = spark.createDataFrame([(1, 2, {"x": "1"}), (1, 1, {"y": "2"}), (2, 5, {})], "k int, o int, more map<string,string>")
    b = spark.range(300).select(F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id")).cast("int").alias("k"), "id")
    got = [(r.k, r.o, r.id) for r in join(a, b, "k", "innerunique", salts=salts).collect()]
    assert sorted(got) == sorted([(1, 1, i) for i in range(300) if i % 3 < 2] + [(2, 5, 2)])
    assert join(a, b, "k", "innerunique", salts=salts).columns == ["k", "o", "more", "id"]


def test_salting_spreads_the_frequent_right_key(spark):
    a = spark.range(50).select(F.col("id").alias("k"))
    b = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 100).alias("k"), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = join(a, b, "k", "inner", salts=16).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in out.groupBy("task").count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 3000 and len(sizes) > 1


def test_empty_right(spark):
    _, _, a, b = frames(spark, 1)
    none = b.filter("rid < 0")
    assert join(a, none, "k", "leftanti").count() == 120 and join(a, none, "k", "leftsemi").count() == 0


def test_all_kinds_named():
    assert len(KINDS) == 9


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        join(spark.range(1), spark.range(1), "id", "cross")


def test_salting_spreads_only_hot_keys(spark):
    a = spark.range(1000).select(F.when(F.col("id") < 600, 0).otherwise(F.col("id")).alias("k"), "id")
    b = spark.range(1000).select(F.col("id").alias("k"))
    out = join(a, b, "k", "inner", salts=8)
    assert out.count() == 1000 and "CartesianProduct" not in plan_of(out)


def test_attach_needs_no_join(spark):
    df = spark.range(10)
    out = attach(df, df.agg(F.max("id").alias("m")), top="m")
    assert {r.top for r in out.collect()} == {9} and "Join" not in plan_of(out)


def test_within_span(spark):
    day = datetime(2024, 1, 1)
    events = spark.createDataFrame([(1, "h", day + timedelta(hours=1.5)), (2, "h", day + timedelta(hours=3))], "id int, host string, t timestamp")
    spans = spark.createDataFrame([("h", day + timedelta(hours=1), day + timedelta(hours=2))], "host string, a timestamp, b timestamp")
    assert [r.id for r in within_span(events, spans, ["host"], "t", "a", "b").collect()] == [1]


@pytest.mark.parametrize("seed", range(3))
def test_followed_by_against_brute_force(spark, seed):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows_ = [(i, rng.choice(["u", "u", "v"]), rng.choice(["A", "B", "C"]), start + timedelta(minutes=rng.randint(0, 600)))
             for i in range(200)]
    df = spark.createDataFrame(rows_, "id int, u string, kind string, t timestamp")
    for then, width in (("B", timedelta(hours=1)), ("A", timedelta(hours=1)), ("B", timedelta(minutes=7, microseconds=13)),
                        ("A", timedelta(days=14)), ("B", timedelta(microseconds=5))):
        got = {r.id: (r.earlier, r.latest_first) for r in
               followed_by(df, ["u"], "t", eq("kind", "A"), eq("kind", then), width).collect()}
        expected = {}
        for i, u, kind, t in rows_:
            before = [x[3] for x in rows_ if x[1] == u and x[2] == "A" and timedelta(0) < t - x[3] <= width]
            if kind == then and before:
                expected[i] = (len(before), max(before))
        assert got == expected
