"""A20, P2: sketches per day, merged for a range."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from huntframe.operators.sketches import (
    distinct_estimate, merge_sketches, new_values, quantile_estimate, sketch_by_period, write_sketches,
)
from huntframe.queries.registry import Tables, query
from huntframe.session import scratch_path

_FROM, _SPLIT, _TO = datetime(2024, 1, 5), datetime(2024, 1, 15), datetime(2024, 1, 20)
_RANGE = f"ts >= TIMESTAMP '{_FROM}' AND ts < TIMESTAMP '{_TO}'"


def _stored(t: Tables, **columns):
    path = scratch_path(t.spark, "sketches")
    write_sketches(sketch_by_period(t.events, ["event_type"], "ts", **columns), path)
    return t.spark.read.parquet(path)


# Up to some hundreds of different values the estimate is exact; it is compared within its stated error of 3 %.
@query("A03_dcount_from_days", f"""SELECT event_type, count(*) AS rows, count(DISTINCT user_id) AS users, true AS near FROM events WHERE {_RANGE}
    GROUP BY event_type""")
def _(t: Tables):
    merged = merge_sketches(_stored(t, distinct=["user_id"]), ["event_type"], _FROM, _TO)
    exact = t.events.filter(_RANGE).groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    guess = distinct_estimate("user_id_distinct")
    return merged.join(exact, "event_type").select("event_type", "rows", "users", (F.abs(guess - F.col("users")) <= 0.03 * F.col("users")).alias("near"))



# The share of values up to the estimated percentile differs from the percentile by less than one in a hundred.
@query("A08_percentile_from_days", f"""SELECT event_type, count(*) AS n, true AS median_near, true AS p95_near FROM events WHERE {_RANGE} GROUP BY event_type""")
def _(t: Tables):
    merged = merge_sketches(_stored(t, quantiles=["value"]), ["event_type"], _FROM, _TO)
    points = merged.select("event_type", quantile_estimate("value_quantiles", 50).alias("m"), quantile_estimate("value_quantiles", 95).alias("p"))
    joined = t.events.filter(_RANGE).join(points, "event_type")
    near = [(F.avg((F.col("value") < F.col(c)).cast("int")) - share <= 0.01) & (F.avg((F.col("value") <= F.col(c)).cast("int")) - share >= -0.01)
            for c, share in (("m", 0.5), ("p", 0.95))]
    return joined.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), near[0].alias("median_near"), near[1].alias("p95_near"))


@query("P02_new_values_from_days", f"""SELECT event_type, count(DISTINCT k) FILTER (ts < TIMESTAMP '{_SPLIT}') AS before,
    count(DISTINCT k) FILTER (ts >= TIMESTAMP '{_SPLIT}') AS after, count(DISTINCT k) - count(DISTINCT k) FILTER (ts < TIMESTAMP '{_SPLIT}') AS fresh
    FROM (SELECT *, CAST(user_id * 10 + event_id % 3 AS BIGINT) % 150 AS k FROM events) WHERE {_RANGE} GROUP BY event_type""")
def _(t: Tables):
    path = scratch_path(t.spark, "sketches")
    events = t.events.withColumn("k", (F.col("user_id") * 10 + F.col("event_id") % 3) % 150)
    write_sketches(sketch_by_period(events, ["event_type"], "ts", distinct=["k"]), path)
    return new_values(t.spark.read.parquet(path), ["event_type"], "k", _SPLIT, _FROM, _TO)
