"""``summarize``: grouped and time-binned aggregation."""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huntframe.functions.durations import time_bin
from huntframe.operators.skew import exact_percentiles, merge_by_key, rank_within


@dataclass(frozen=True)
class Agg:
    """One aggregate; build it with the functions below."""

    kind: str
    field: str | None = None
    limit: int | None = None
    point: float | None = None
    order: tuple[str, ...] = ()
    approx: bool = False


@dataclass(frozen=True)
class Pick:
    """The row at the greatest or smallest value of a column."""

    kind: str
    order: str
    carry: tuple[str, ...]
    alias: str | None = None
    first: str | None = dc_field(default=None)


def count(field: str | None = None) -> Agg:
    """Rows in the group, also where the named field is null."""
    return Agg("count", field)


def dcount(field: str, approx: bool = False) -> Agg:
    return Agg("dcount", field, approx=approx)


def total(field: str) -> Agg:
    """Sum of the numeric values; 0 when there is none."""
    return Agg("sum", field)


def avg(field: str) -> Agg:
    return Agg("avg", field)


def minimum(field: str) -> Agg:
    return Agg("min", field)


def maximum(field: str) -> Agg:
    return Agg("max", field)


def stdev(field: str) -> Agg:
    return Agg("stdev", field)


def variance(field: str) -> Agg:
    return Agg("variance", field)


def percentile(field: str, point: float, approx: bool = False) -> Agg:
    """Percentile ``0..100``, exact with linear interpolation, or a bounded sketch with ``approx``."""
    return Agg("percentile", field, point=point, approx=approx)


def make_set(field: str, limit: int | None = None, order: tuple[str, ...] = ()) -> Agg:
    """Distinct non-null values in order of first appearance along ``order``.

    An array has to fit a row. For groups of any size ``distinct_items`` gives the same as rows.
    """
    return Agg("make_set", field, limit=limit, order=order)


def make_list(field: str, limit: int | None = None, order: tuple[str, ...] = ()) -> Agg:
    """Non-null values along ``order``; ``listed_items`` gives the same as rows, for groups of any size."""
    return Agg("make_list", field, limit=limit, order=order)


def arg_max(order: str, *carry: str, alias: str | None = None, first: str | None = None) -> Pick:
    """The row with the greatest ``order``; ``"*"`` carries all columns.

    ``first`` names a numeric sequence column: of equal rows the smallest one wins.
    """
    return Pick("arg_max", order, carry, alias, first)


def arg_min(order: str, *carry: str, alias: str | None = None, first: str | None = None) -> Pick:
    return Pick("arg_min", order, carry, alias, first)


def _number(field: str) -> Column:
    return F.col(field).try_cast("double")


def _mergeable(agg: Agg) -> Column | None:
    """Aggregates Spark pre-combines on the map side in bounded space."""
    kind, field = agg.kind, agg.field
    if kind == "count":
        return F.count(F.lit(1))
    if kind == "dcount":
        return F.approx_count_distinct(field) if agg.approx else F.count_distinct(field)
    if kind == "sum":
        return F.coalesce(F.sum(_number(field)), F.lit(0.0))
    if kind == "percentile" and agg.approx:
        return F.percentile_approx(_number(field), agg.point / 100.0, 10_000)
    plain = {"min": F.min, "max": F.max}
    if kind in plain:
        return plain[kind](field)
    numeric = {"avg": F.avg, "stdev": F.stddev_samp, "variance": F.var_samp}
    return numeric[kind](_number(field)) if kind in numeric else None


def _pick(pick: Pick, columns: list[str]) -> Column:
    carried = [F.col(c) for c in columns]
    rank = [F.col(pick.order)]
    if pick.first:
        rank.append(-F.col(pick.first) if pick.kind == "arg_max" else F.col(pick.first))
    key = F.when(F.col(pick.order).isNotNull(), F.struct(*rank))
    best = F.max_by if pick.kind == "arg_max" else F.min_by
    return best(F.struct(F.col(pick.order).alias("_order"), *carried), key)


def distinct_items(df: DataFrame, by: list[str], field: str) -> DataFrame:
    """The members of ``make_set`` as rows: the same content without an array per group."""
    return df.filter(F.col(field).isNotNull()).select(*by, field).distinct()


def listed_items(df: DataFrame, by: list[str], field: str, order: list[str], time: str,
                 slice_width: str = "PT1H") -> DataFrame:
    """The members of ``make_list`` as rows with their ``position`` (from 1).

    Same content and order as the array, for groups of any size: positions are counted per time
    slice, and ``order`` must start with the time column.
    """
    if not order or order[0] != time:
        raise ValueError("order must start with the time column")
    rows = df.filter(F.col(field).isNotNull()).select(*dict.fromkeys([*by, field, *order]))
    placed = rank_within(rows, by, [F.col(c) for c in order], time_bin(F.col(time), slice_width), "position")
    return placed.select(*by, "position", field)


def _collected(df: DataFrame, keys: list[str], alias: str, agg: Agg) -> DataFrame:
    item, order = F.col(agg.field).alias("_item"), F.struct(*(agg.order or (agg.field,))).alias("_at")
    rows = df.filter(F.col(agg.field).isNotNull()).select(*keys, item, order)
    if agg.kind == "make_set":
        # One row per distinct value before anything is gathered by group.
        rows = rows.groupBy(*keys, "_item").agg(F.min("_at").alias("_at"))
    if agg.limit is not None:
        rows = _first_rows(rows, keys, agg.limit)
    pairs = F.sort_array(F.collect_list(F.struct("_at", "_item")))
    grouped = rows.groupBy(*keys).agg(pairs.alias("_pairs"))
    return grouped.select(*keys, F.transform("_pairs", lambda p: p["_item"]).alias(alias))


def _first_rows(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    if not keys:
        return rows.orderBy("_at", "_item").limit(limit)
    # Each group is trimmed part by part first, so that no task sorts a whole group.
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_item", "_at"), F.lit(64)))
    part = Window.partitionBy(*keys, "_salt").orderBy("_at", "_item")
    rows = salted.withColumn("_rn", F.row_number().over(part)).filter(F.col("_rn") <= limit).drop("_rn", "_salt")
    group = Window.partitionBy(*keys).orderBy("_at", "_item")
    return rows.withColumn("_rn", F.row_number().over(group)).filter(F.col("_rn") <= limit).drop("_rn")


def summarize(df: DataFrame, by: list[str] | tuple[str, ...] = (), every: str | None = None,
              time: str = "TimeGenerated", origin: datetime | None = None, keep_bin: bool = True,
              picks: tuple[Pick, ...] = (), **aggs: Agg) -> DataFrame:
    """Aggregate by keys and, with ``every``, by tumbling bins of the time column.

    Null keys form a group. Without keys an empty input gives no row. Without aggregates the
    distinct keys are returned. The bin start is kept under the time column's name.
    """
    keys = list(by)
    if every is not None:
        kind = df.schema[time].dataType.simpleString()
        df = df.withColumn("_bin", time_bin(F.col(time), every, origin, kind))
        keys.append("_bin")
    if not aggs and not picks:
        result = df.select(*keys).distinct()
    else:
        result = _grouped(df, keys, picks, aggs)
    if every is None:
        return result
    return result.withColumnRenamed("_bin", time) if keep_bin else result.drop("_bin")


def _grouped(df: DataFrame, keys: list[str], picks: tuple[Pick, ...], aggs: dict[str, Agg]) -> DataFrame:
    plain = {alias: _mergeable(agg) for alias, agg in aggs.items()}
    columns = {i: _carried(p, df, keys) for i, p in enumerate(picks)}
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[col.alias(alias) for alias, col in plain.items() if col is not None],
        *[_pick(p, columns[i]).alias(f"_pick{i}") for i, p in enumerate(picks)])

    frames = [base]
    points: dict[str, dict[str, float]] = {}
    for alias, agg in aggs.items():
        if agg.kind in ("make_set", "make_list"):
            frames.append(_collected(df, keys, alias, agg))
        elif agg.kind == "percentile" and not agg.approx:
            points.setdefault(agg.field, {})[alias] = agg.point
    for field, wanted in points.items():
        frames.append(exact_percentiles(df, keys, F.col(field), wanted))

    merged = merge_by_key(frames, keys)
    if not keys:
        merged = merged.filter(F.col("_rows") > 0)

    def output(alias: str, agg: Agg) -> Column:
        if agg.kind in ("make_set", "make_list"):
            return F.coalesce(F.col(alias), F.array().cast(merged.schema[alias].dataType)).alias(alias)
        return F.col(alias)

    picked = []
    for i, p in enumerate(picks):
        # Of an aliased order column only the alias stays; a carried name is not repeated.
        picked.append(F.col(f"_pick{i}._order").alias(p.alias or p.order))
        picked += [F.col(f"_pick{i}.{c}").alias(c) for c in columns[i] if c != p.order]
    return merged.select(*keys, *[output(a, agg) for a, agg in aggs.items()], *picked)


def _carried(pick: Pick, df: DataFrame, keys: list[str]) -> list[str]:
    if "*" in pick.carry:
        return [c for c in df.columns if c not in keys and c != pick.order]
    return [c for c in pick.carry if c not in keys and c != pick.order]
