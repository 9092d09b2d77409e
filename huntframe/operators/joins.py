"""The nine join kinds on shared key names, and joins with a time condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huntframe.functions.durations import duration_micros, floor_div, from_micros, micros_of
from huntframe.operators.skew import holds_map, null_safe_join, salted_join

KINDS = ("inner", "innerunique", "leftouter", "rightouter", "fullouter",
         "leftanti", "leftsemi", "rightanti", "rightsemi")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first along ``order``; combined on the map side, no sort of a group.

    Columns that cannot be compared (maps) are left out of the order.
    """
    order = [c for c in order if not holds_map(df.schema[c].dataType)]
    row = F.min_by(F.struct(*df.columns), F.struct(*order)) if order else F.any_value(F.struct(*df.columns))
    return df.groupBy(*keys).agg(row.alias("_row")).select("_row.*")


def join(left: DataFrame, right: DataFrame, on: list[str] | str, kind: str = "innerunique",
         null_safe: bool = False, first: list[str] | None = None, salts: int = 0) -> DataFrame:
    """Join on equally named keys.

    * A right column whose name the left has too gets the suffix ``_right``.
    * ``innerunique`` keeps, of left rows with equal keys, the first along ``first``
      (all columns when not given), and every matching right row.
    * ``null_safe`` lets null keys match each other; by default they match nothing.
    * ``salts`` spreads the rows of very frequent keys over that many groups, on the left side
      or, for the right kinds, on the right side. Without it Spark's adaptive skew split applies.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if kind not in KINDS:
        raise ValueError(f"unknown join kind {kind!r}")
    if kind in ("rightanti", "rightsemi"):
        return join(right, left, keys, kind.replace("right", "left"), null_safe, salts=salts)
    if kind in ("leftanti", "leftsemi"):
        members = right.select(*keys).distinct()
        how = "left_anti" if kind == "leftanti" else "left_semi"
        return _joined(left, members, keys, how, null_safe, salts)

    taken = [c for c in right.columns if c in left.columns and c not in keys]
    right = right.withColumnsRenamed({c: f"{c}_right" for c in taken})
    if kind == "innerunique":
        left = first_per_key(left, keys, first or left.columns)
        order = [*left.columns, *[c for c in right.columns if c not in keys]]
        # Only the right side can hold a key often.
        return _joined(right, left, keys, "inner", null_safe, salts).select(*order)
    if kind == "rightouter":
        order = [c for c in left.columns] + [c for c in right.columns if c not in keys]
        return _joined(right, left, keys, "left", null_safe, salts).select(*order)
    if kind == "fullouter":
        return _full(left, right, keys, null_safe, salts)
    return _joined(left, right, keys, {"inner": "inner", "leftouter": "left"}[kind], null_safe, salts)


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str, null_safe: bool,
            salts: int) -> DataFrame:
    if salts:
        return salted_join(left, right, keys, how, salts, null_safe=null_safe)
    if null_safe:
        return null_safe_join(left, right, keys, how)
    return left.join(right, keys, how)


def _full(left: DataFrame, right: DataFrame, keys: list[str], null_safe: bool, salts: int) -> DataFrame:
    if not null_safe and not salts:
        return left.join(right, keys, "full")
    matched = _joined(left, right, keys, "left", null_safe, salts)
    members = left.select(*keys).distinct()
    unmatched = _joined(right, members, keys, "left_anti", null_safe, salts)
    return matched.unionByName(unmatched, allowMissingColumns=True)


def attach(df: DataFrame, one_row: DataFrame, **columns: str) -> DataFrame:
    """Put values of a one-row statistic next to every row: ``attach(df, stats, limit="p5")``.

    The statistic enters as a scalar subquery, so no join takes place.
    """
    return df.withColumns({name: one_row.select(source).scalar() for name, source in columns.items()})


def within_span(events: DataFrame, spans: DataFrame, on: list[str], time: str, first: str, last: str,
                salts: int = 0) -> DataFrame:
    """Events that fall inside the ``[first, last]`` span of the same entity."""
    return join(events, spans, on, "inner", salts=salts).filter(
        (F.col(time) >= F.col(first)) & (F.col(time) <= F.col(last)))


_SLICES = 64  # slices per window, at least that many microseconds


def followed_by(events: DataFrame, keys: list[str], time: str, first: Column, then: Column,
                within: str) -> DataFrame:
    """``then`` events that come after a ``first`` event of the same entity, at most ``within`` later.

    Adds how many such earlier events there are (``earlier``) and the time of the latest one
    (``latest_first``). Pairs are never built, and a busy entity is cut into time slices of a 64th
    of the window. A running sum per slice gives the count: it starts with what has entered and not
    yet left the window in the slices before, each ``first`` event adds one, and takes it back in the
    slice in which it leaves. The windows of an entity's slices, a row per slice, meet in one task.
    """
    width = duration_micros(within)
    if width < 1:
        raise ValueError("the window must be at least a microsecond long")
    step = -(-width // _SLICES)
    kind = events.schema[time].dataType.simpleString()
    marked = (events.withColumns({"_at": micros_of(F.col(time)), "_first": first, "_then": then})
              .filter(F.col("_at").isNotNull() & (F.col("_first") | F.col("_then")))
              .withColumn("_slice", floor_div(F.col("_at"), step)))
    at, own = F.col("_at"), F.col("_slice")

    def entry(place: Column, moment: Column, weight: int, seen: Column, kept: bool) -> Column:
        return F.struct(place.alias("_slice"), moment.alias("_at"), F.lit(weight).cast("long").alias("_weight"),
                        seen.alias("_seen"), F.lit(kept).alias("_kept"))

    unseen = F.lit(None).cast("long")
    entries = F.array_compact(F.array(
        F.when(F.col("_then"), entry(own, at, 0, unseen, True)),
        F.when(F.col("_first"), entry(own, at, 1, at, False)),
        F.when(F.col("_first"), entry(floor_div(at + width, step), at + width, -1, unseen, False))))
    rest = [c for c in events.columns if c not in keys]
    placed = marked.withColumn("_entry", F.explode(entries)).select(
        *keys, "_entry.*", *[F.when(F.col("_entry._kept"), F.col(c)).alias(c) for c in rest])

    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = placed.groupBy(*keys, "_slice").agg(F.sum("_weight").alias("_n"), F.max("_seen").alias("_last"))
    heads = per_slice.select(
        *keys, "_slice", (F.col("_slice") * step - 1).alias("_at"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_weight"),
        F.max("_last").over(before).alias("_seen"))

    running = (Window.partitionBy(*keys, "_slice").orderBy("_at")
               .rangeBetween(Window.unboundedPreceding, -1))
    counted = placed.unionByName(heads, allowMissingColumns=True).withColumns({
        "earlier": F.sum("_weight").over(running),
        "latest_first": from_micros(F.max("_seen").over(running), kind)})
    return counted.filter(F.col("_kept") & (F.col("earlier") > 0)).select(
        *events.columns, "earlier", "latest_first")
