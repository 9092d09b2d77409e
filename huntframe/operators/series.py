"""Zero-filled time series per group and leave-one-out outlier scores."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.functions.durations import (
    duration_micros, epoch_micros, floor_div, from_micros, micros_of,
)
from huntframe.functions.let import let
from huntframe.operators.aggregates import Agg, summarize
from huntframe.operators.stages import mv_expand


def bucket_count(start: datetime, stop: datetime, step: str) -> int:
    return max(1, (epoch_micros(stop) - epoch_micros(start)) // duration_micros(step))


def make_series(df: DataFrame, start: datetime, stop: datetime, step: str, by: list[str] | tuple = (),
                time: str = "TimeGenerated", fill: float = 0, **aggs: Agg) -> DataFrame:
    """One row per group with an array of values per aggregate, one per time bucket.

    Buckets without rows hold ``fill``; groups without any row in range are kept. Rows are
    aggregated per (group, bucket) first, so an array is gathered from at most one row per bucket.
    """
    keys = list(by)
    width, origin, n = duration_micros(step), epoch_micros(start), bucket_count(start, stop, step)
    kind = df.schema[time].dataType.simpleString()
    place = floor_div(micros_of(F.col(time)) - F.lit(origin), width)
    placed = df.withColumn("_bucket", F.when((place >= 0) & (place < n), place.cast("int")))
    per_bucket = summarize(placed, [*keys, "_bucket"], **aggs)

    entry = F.struct("_bucket", F.struct(*aggs).alias("_values"))
    entries = F.collect_list(F.when(F.col("_bucket").isNotNull(), entry))
    lookup = per_bucket.groupBy(*keys).agg(F.map_from_entries(entries).alias("_filled"))
    positions = F.sequence(F.lit(0), F.lit(n - 1))

    def values(alias: str) -> Column:
        empty = F.lit(fill).cast(per_bucket.schema[alias].dataType)
        return F.transform(positions, lambda i: F.coalesce(F.col("_filled")[i][alias], empty))

    starts = F.transform(positions, lambda i: from_micros(
        F.lit(origin) + i.cast("long") * F.lit(width), kind))
    return lookup.select(*keys, starts.alias(time), *[values(a).alias(a) for a in aggs])


def series_anomaly(df: DataFrame, series: str, threshold: float = 1.5, flag: str = "AnomalyFlag",
                   score: str = "AnomalyScore", baseline: str = "Baseline") -> DataFrame:
    """Score each point against the mean and population deviation of all other points.

    A deviation of zero counts as 1e-9. The flag is 1 above the threshold, -1 below its negative,
    otherwise 0. A series of one point has no other points: its score and baseline are null.

    The rest of a series is taken from the whole by subtraction, in one pass per point, except
    where that would cancel (one point carries nearly all of the spread): there it is summed anew.
    """
    points = df.withColumn("_v", F.transform(series, lambda x: x.cast("double")))
    n = F.size("_v").cast("double")
    rest_n = n - 1
    points = points.withColumn("_mean", _sum(F.col("_v")) / n)
    points = points.withColumn("_spread", _sum(F.transform("_v", lambda x: _sq(x - F.col("_mean")))))

    def scored_by(x: Column, mean: Column, spread: Column) -> Column:
        deviation = F.sqrt(spread / rest_n)
        floor = F.when(deviation > 0, deviation).otherwise(F.lit(1e-9))
        return F.struct(((x - mean) / floor).alias("z"), mean.alias("mean"))

    def around(x: Column, i: Column) -> Column:
        off = x - F.col("_mean")
        quick = F.col("_spread") - _sq(off) * n / rest_n
        rest = F.filter("_v", lambda _, j: j != i)
        anew = let(_sum(rest) / rest_n, lambda mean: scored_by(
            x, mean, _sum(F.transform(rest, lambda y: _sq(y - mean)))))
        return F.when(quick > F.col("_spread") * F.lit(1e-6),
                      scored_by(x, F.col("_mean") - off / rest_n, quick)).otherwise(anew)

    nothing = F.struct(F.lit(None).cast("double").alias("z"), F.lit(None).cast("double").alias("mean"))
    scored = F.transform("_v", lambda x, i: F.when(n > 1, around(x, i)).otherwise(nothing))
    flags = F.transform("_scored", lambda s: F.when(s["z"] > threshold, F.lit(1))
                        .when(s["z"] < -threshold, F.lit(-1)).otherwise(F.lit(0)))
    return points.withColumn("_scored", scored).withColumns({
        flag: flags,
        score: F.transform("_scored", lambda s: s["z"]),
        baseline: F.transform("_scored", lambda s: s["mean"]),
    }).drop("_v", "_mean", "_spread", "_scored")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _sq(x: Column) -> Column:
    return x * x


def expand_series(df: DataFrame, time: str, *fields: str) -> DataFrame:
    """Back to one row per group and bucket."""
    return mv_expand(df, time, *fields)
