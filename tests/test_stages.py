import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from huntframe.operators.stages import (
    ANY, Capture, extend, fires, flatten_struct, mv_expand, parse, project, top, union, union_tables, where,
)
from huntframe.functions import predicates as P


def test_project_unknown_name_raises(spark):
    with pytest.raises(AnalysisException):
        project(spark.range(1), "id", "nothing").collect()


def test_extend_is_sequential(spark):
    row = extend(spark.range(3, 4), a=F.col("id") + 1, b=F.col("a") * 2).first()
    assert (row.a, row.b) == (4, 8)


def test_parse_value_and_no_match(spark):
    df = spark.createDataFrame([
        ("Lookup of host (evil.example.com) at port 443",), ("no parens here at all",), (None,),
        ("two\nlines (a.b)",), ("()",)], "m string")
    got = [r.DNSName for r in parse(df, "m", ANY, "(", Capture("DNSName"), ")", ANY).collect()]
    assert got == ["evil.example.com", None, None, "a.b", ""]


def test_parse_several_and_names_with_underscores(spark):
    df = spark.createDataFrame([("user=bob;ip=10.0.0.1;end",)], "m string")
    row = parse(df, "m", "user=", Capture("user_name"), ";ip=", Capture("ip_addr"), ";", ANY).first()
    assert (row.user_name, row.ip_addr) == ("bob", "10.0.0.1")


def test_parse_then_endswith(spark):
    df = spark.createDataFrame([("x (c2.evil.example.com) y",), ("x (safe.microsoft.com) y",)], "m string")
    parsed = parse(df, "m", ANY, "(", Capture("d"), ")", ANY)
    assert where(parsed, P.endswith("d", "Evil.Example.com")).count() == 1


def test_mv_expand_one_field(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, []), (3, None)], "id int, tags array<string>")
    assert sorted((r.id, r.tags or "") for r in mv_expand(df, "tags").collect()) == [
        (1, "a"), (1, "b"), (1, "c"), (2, ""), (3, "")]


def test_mv_expand_cast(spark):
    df = spark.createDataFrame([(["1", "2"],)], "n array<string>")
    assert [r.n for r in mv_expand(df, "n", to="long").collect()] == [1, 2]


def test_mv_expand_lockstep_shortest_and_scalar(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], ["a", "b"], 7), (2, [1], [], 8), (3, [5], None, 9)],
                               "id int, x array<int>, y array<string>, z int")
    got = sorted(((r.id, r.x, r.y) for r in mv_expand(df, "x", "y").collect()), key=str)
    assert got == [(1, 1, "a"), (1, 2, "b"), (3, 5, None)]
    assert [(r.x, r.z) for r in mv_expand(df.filter("id = 1"), "x", "z").collect()] == [(1, 7)]


def test_top_puts_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(1, 1), (2, 5), (3, 3), (4, None)], "id int, n int")
    assert [r.id for r in top(df, 1, "n").collect()] == [2]
    assert [r.id for r in top(df, 3, "n", desc=False).collect()] == [1, 3, 2]


def test_union_is_outer(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, s string"), spark.createDataFrame([(2, 5)], "id int, n int")
    assert sorted((r.id, r.s, r.n) for r in union(a, b).collect()) == [(1, "x", None), (2, None, 5)]
    with pytest.raises(ValueError):
        union()


def test_union_tables_fuzzy(spark):
    spark.range(2).createOrReplaceTempView("known_view")
    assert union_tables(spark, "known_view", "absent_view", fuzzy=True).count() == 2
    with pytest.raises(AnalysisException):
        union_tables(spark, "known_view", "absent_view").count()


def test_flatten_and_fires(spark):
    df = flatten_struct(spark.range(1).select(F.struct(F.lit(1).alias("a"), F.lit(2).alias("b")).alias("s")), "s")
    assert df.columns == ["a", "b"] and fires(df) and not fires(df.filter("a > 1"))
