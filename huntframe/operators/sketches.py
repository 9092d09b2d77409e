"""Sketches per day that merge for any range, so that a baseline does not read its events again."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.functions.durations import time_bin, time_literal

#: Registers (as a power of two) of a distinct-count sketch: standard error 1.04 / sqrt(2^14), 0.8 %.
REGISTERS = 14
#: Size of a quantile sketch: rank error about 1.7 / k, 0.2 %; exact up to k values.
QUANTILE_SIZE = 1024


def _hashable(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.simpleString()
    return F.col(column) if kind in ("int", "bigint", "string", "binary") else F.col(column).cast("string")


def sketch_by_period(df: DataFrame, by: list[str], time: str, distinct: list[str] = (), quantiles: list[str] = (), every: str = "P1D",
                     period: str = "period", registers: int = REGISTERS, size: int = QUANTILE_SIZE) -> DataFrame:
    """One row per group and period: ``rows``, and for each named column ``<column>_distinct`` or ``<column>_quantiles``,
    a mergeable sketch of its values. Nulls, and what is no number in a quantile column, are passed over. Rows without a
    time take no part. Sketches are made on the map side, so a heavy group moves as a few sketches."""
    placed = df.withColumn(period, time_bin(F.col(time), every, kind=df.schema[time].dataType.simpleString())).filter(F.col(period).isNotNull())

    def number(c: str) -> Column:
        value = F.col(c).try_cast("double")
        return F.when(~F.isnan(value), value)

    return placed.groupBy(*by, period).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.hll_sketch_agg(_hashable(df, c), registers).alias(f"{c}_distinct") for c in distinct],
        *[F.kll_sketch_agg_double(number(c), size).alias(f"{c}_quantiles") for c in quantiles])


def write_sketches(sketches: DataFrame, path: str, period: str = "period") -> None:
    """Store sketches by day; a range then reads its days only. New days are added by a later call."""
    dated = sketches.withColumn("sketch_day", F.to_date(period)).hint("rebalance", F.col("sketch_day"))
    dated.write.mode("append").partitionBy("sketch_day").parquet(path)


def merge_sketches(sketches: DataFrame, by: list[str], start: datetime | None = None, stop: datetime | None = None,
                   period: str = "period", when: dict[str, Column] | None = None) -> DataFrame:
    """One row per group for the periods from ``start`` up to, not including, ``stop``: summed rows, merged sketches.

    ``when`` makes several sets in one pass: for ``{"old": condition, ...}`` columns are called ``old_rows`` and so on.
    """
    held = sketches
    for moment, keep in ((start, lambda c, m: c >= m), (stop, lambda c, m: c < m)):
        if moment is not None:
            held = held.filter(keep(F.col(period), time_literal(moment)))
            if "sketch_day" in held.columns:
                held = held.filter(F.col("sketch_day") >= F.lit(moment.date()) if moment is start else F.col("sketch_day") <= F.lit(moment.date()))
    merged = []
    for name, condition in (when or {"": F.lit(True)}).items():
        prefix = f"{name}_" if name else ""
        merged.append(F.coalesce(F.sum(F.when(condition, F.col("rows"))), F.lit(0)).alias(f"{prefix}rows"))
        for c in sketches.columns:
            if c.endswith("_distinct"):
                merged.append(F.hll_union_agg(F.when(condition, F.col(c))).alias(prefix + c))
            elif c.endswith("_quantiles"):
                merged.append(F.kll_merge_agg_double(F.when(condition, F.col(c))).alias(prefix + c))
    return held.groupBy(*by).agg(*merged)


def distinct_estimate(sketch: str | Column) -> Column:
    """About how many different values a sketch has seen; 0 for none."""
    return F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0).cast("long"))


def quantile_estimate(sketch: str | Column, point: float) -> Column:
    """The value at a percentile (0 to 100) of what a sketch has seen, one of its values; null for none."""
    column = F.col(sketch) if isinstance(sketch, str) else sketch
    return F.when(F.kll_sketch_get_n_double(column) > 0, F.kll_sketch_get_quantile_double(column, F.lit(point / 100)))


def new_values(sketches: DataFrame, by: list[str], column: str, split: datetime, start: datetime | None = None, stop: datetime | None = None,
               period: str = "period") -> DataFrame:
    """Per group the different values of a column before and from ``split`` on (``before``, ``after``), and how many of
    the later ones are new (``fresh``), from sketches alone: no event is read."""
    old = F.col(period) < time_literal(split)
    both = merge_sketches(sketches.select(*by, period, "rows", f"{column}_distinct", *[c for c in sketches.columns if c == "sketch_day"]), by,
                          start, stop, period, {"old": old, "new": ~old, "all": F.lit(True)})
    before = distinct_estimate(f"old_{column}_distinct")
    return both.select(*by, before.alias("before"), distinct_estimate(f"new_{column}_distinct").alias("after"),
                       F.greatest(distinct_estimate(f"all_{column}_distinct") - before, F.lit(0).cast("long")).alias("fresh"))
