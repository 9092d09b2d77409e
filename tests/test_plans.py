"""The physical plans behind the queries."""

import pytest

from plans import plan_of
from huntframe.queries.catalog import QUERIES


def plan(spark, folder, name):
    return plan_of(QUERIES[name](spark, folder))


@pytest.mark.parametrize("name", ["P02_baseline_vs_current", "P03_ordered_pair", "P12_first_seen", "P06_regularity",
                                  "P17_inventory", "T1_make_series", "A13_arg_max_all", "P07_outlier_buckets"])
def test_one_scan(spark, folder, name):
    text = plan(spark, folder, name)
    assert text.count("FileScan") == 1 and "Join" not in text


@pytest.mark.parametrize("name, columns", [
    ("P16_noisiest", "ReadSchema: struct<user_id:bigint>"),
    ("P02_baseline_vs_current", "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>"),
    ("P08_latest_row", "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double,props:string>"),
    ("A09_make_set", "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>"),
])
def test_columns_read(spark, folder, name, columns):
    assert columns in plan(spark, folder, name)


def test_pairs_in_a_window_need_no_join(spark, folder):
    assert "Join" not in plan(spark, folder, "J13_ordered_within_window")


def test_top_is_not_a_full_sort(spark, folder):
    assert "TakeOrderedAndProject" in plan(spark, folder, "P16_noisiest")


def test_only_bounded_broadcast_hints(spark, folder):
    import inspect

    from huntframe.operators import aggregates, joins, series, skew, stages
    from huntframe.plans import conformance, corpus, detections, evaluation, retrieval

    hinted = [m.__name__ for m in (aggregates, joins, series, skew, stages, conformance, corpus, detections, evaluation, retrieval)
              if "F.broadcast" in inspect.getsource(m)]
    assert hinted == ["huntframe.operators.skew"]


def test_no_single_task_rank(spark, folder):
    # Ranks inside strata are cut by hash prefix, so no window is partitioned by the stratum alone.
    text = plan(spark, folder, "B05_stratified_split")
    assert "row_number() windowspecdefinition(lang#" in text and "_bucket#" in text.split("row_number()", 1)[1][:60]


@pytest.mark.parametrize("kind, bound", [("int", 100), ("bigint", 100.0), ("double", 2.5), ("smallint", "7")])
def test_bounds_reach_the_scan(spark, tmp_path, kind, bound):
    from pyspark.sql import functions as F

    from huntframe.functions import predicates as P

    path = str(tmp_path / kind)
    spark.range(10).select(F.col("id").cast(kind).alias("x")).write.parquet(path)
    df = spark.read.parquet(path)
    for test, sign in ((P.gt, "GreaterThan(x"), (P.ge, "GreaterThanOrEqual(x"), (P.lt, "LessThan(x"), (P.le, "LessThanOrEqual(x")):
        assert sign in plan_of(df.filter(test("x", bound))), (kind, sign)
