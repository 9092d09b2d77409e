"""Sequences of steps, row numbers and previous rows, without one entity in one task."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huntframe.functions.durations import duration_micros, floor_div, from_micros, micros_of
from huntframe.operators.skew import rank_within

_SLICES = 64  # slices of time per window


@dataclass(frozen=True)
class Step:
    """What an event must be like, and which columns name the entity it belongs to in this step.

    A step that is tied to another attribute of the earlier ones names it here: ``Step(is_logon, ["TargetUser"])``
    followed by ``Step(is_process, ["ActorUser"])`` asks for a process of the user that was logged on to.
    """

    when: Column
    entity: tuple[str | Column, ...] | list | None = None


def _largest(*columns: Column) -> Column:
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def scan_steps(events: DataFrame, by: list[str], time: str, steps: list[Step | Column], within: str,
               started: str = "started") -> DataFrame:
    """Events that end a sequence of steps of one entity, each later than the one before, the last at most ``within``
    after the first. Adds the time of the first step, of several sequences the latest.

    ``by`` names the entity where a step does not. Events without a time or with a null in their entity take no part.
    An entity is cut into time slices of a 64th of the window. For every slice it is worked out which steps it can
    carry a sequence through, from each step to each later one, and the latest begin of what starts inside. These
    summaries compose: what a slice begins with follows from at most the 64 slices before, so neither an entity nor
    its list of slices meets in one task.
    """
    steps = [s if isinstance(s, Step) else Step(s) for s in steps]
    n, width = len(steps), duration_micros(within)
    if n < 2:
        raise ValueError("a sequence has two steps at least")
    slice_ = -(-width // _SLICES)
    kind = events.schema[time].dataType.simpleString()
    names = [f"_e{i}" for i in range(len(by))]
    entities = [[F.col(c) if isinstance(c, str) else c for c in (s.entity if s.entity is not None else by)] for s in steps]
    if any(len(e) != len(by) for e in entities):
        raise ValueError("the entity of a step has as many columns as `by`")

    entries = F.array_compact(F.array(*[
        F.when(s.when, F.struct(F.lit(i + 1).alias("_step"), *[c.alias(n_) for c, n_ in zip(e, names)]))
        for i, (s, e) in enumerate(zip(steps, entities))]))
    row = F.struct(*events.columns)
    placed = events.withColumns({"_at": micros_of(F.col(time)), "_entry": F.explode(entries)}).select(
        "_at", "_entry.*", F.when(F.col("_entry._step") == n, row).alias("_row"))
    placed = placed.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ["_at", *names]]))
    placed = placed.withColumn("_slice", floor_div(F.col("_at"), slice_))

    part = [*names, "_slice"]
    earlier = Window.partitionBy(*part).orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    step = F.col("_step")

    # Per slice: the latest begin of what reaches step k inside (f_k), and whether it leads from step i to step k (r_i_k).
    inside = placed.select(*part, "_at", "_step").withColumns({
        "_f1": F.when(step == 1, F.col("_at")), **{f"_r{i}_{i + 1}": F.when(step == i + 1, F.lit(1)) for i in range(1, n - 1)}})
    for k in range(2, n):
        inside = inside.withColumns({f"_f{k}": F.when(step == k, F.max(f"_f{k - 1}").over(earlier)), **{
            f"_r{i}_{k}": F.when(step == k, F.max(f"_r{i}_{k - 1}").over(earlier)) for i in range(1, k - 1)}})
    carried = [c for c in inside.columns if c.startswith(("_f", "_r"))]
    summaries = inside.groupBy(*part).agg(*[F.max(c).alias(c) for c in carried])

    # What comes into a slice: the summaries of the slices of one window before it, in order.
    group = F.explode(F.array(floor_div(F.col("_slice"), _SLICES), floor_div(F.col("_slice"), _SLICES) + 1))
    copies = summaries.withColumn("_group", group)
    before = Window.partitionBy(*names, "_group").orderBy("_slice").rangeBetween(-_SLICES - 1, -1)
    lists = copies.withColumn("_list", F.collect_list(F.struct(*carried)).over(before)).filter(
        F.col("_group") == floor_div(F.col("_slice"), _SLICES))
    nothing = F.struct(*[F.lit(None).cast("long").alias(f"s{k}") for k in range(1, n)])

    def after(state: Column, s: Column) -> Column:
        return F.struct(*[_largest(state[f"s{k}"], s[f"_f{k}"], *[
            F.when(s[f"_r{i}_{k}"] == 1, state[f"s{i}"]) for i in range(1, k)]).alias(f"s{k}") for k in range(1, n)])

    heads = lists.withColumn("_in", F.aggregate("_list", nothing, after)).select(
        *part, (F.col("_slice") * slice_ - 1).alias("_at"), "_in")

    reached = placed.unionByName(heads, allowMissingColumns=True)
    reached = reached.withColumn("_s1", F.when(step == 1, F.col("_at")).otherwise(F.col("_in.s1")))
    for k in range(2, n + 1):
        own = F.when(step == k, F.max(f"_s{k - 1}").over(earlier))
        reached = reached.withColumn(f"_s{k}", F.coalesce(own, F.col(f"_in.s{k}")) if k < n else own)
    found = reached.filter((step == n) & (F.col("_at") - F.col(f"_s{n}") <= width))
    return found.select("_row.*", from_micros(F.col(f"_s{n}"), kind).alias(started))


def serialize(df: DataFrame, order: list[str], bucket: Column, by: list[str] | None = None, number: str = "row_number") -> DataFrame:
    """Numbers the rows along ``order`` from 1, in each group of ``by`` or over the whole table.

    ``bucket`` grows with ``order``, such as the day of a time; rows are sorted within a bucket only, and numbers are
    made whole with the counts of the buckets before, a row per bucket.
    """
    keys = list(by or [])
    whole = df if keys else df.withColumn("_all", F.lit(0))
    ranked = rank_within(whole, keys or ["_all"], [F.col(c) for c in order], bucket, number)
    return ranked.select(*df.columns, F.col(number).cast("long").alias(number))


def with_previous(df: DataFrame, by: list[str], time: str, every: str, columns: dict[str, str], order: list[str] | None = None) -> DataFrame:
    """Adds values of the row before, in the same group along ``time`` and then ``order``: ``{"last_value": "value"}``.

    Groups are cut into slices of ``every``. The first row of a slice takes the last row of the slice before it that
    has rows, so only the last rows of a group's slices meet in one task. Rows without a time come first.
    """
    along = [time, *(order or [])]
    cut = df.withColumn("_slice", F.coalesce(floor_div(micros_of(F.col(time)), duration_micros(every)), F.lit(-(1 << 62))))
    held = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    last = cut.groupBy(*by, "_slice").agg(F.max_by(held, F.struct(*along)).alias("_last"))
    heads = last.withColumns({"_before": F.lag("_last").over(Window.partitionBy(*by).orderBy("_slice")), "_head": F.lit(True)})
    stacked = cut.unionByName(heads.drop("_last"), allowMissingColumns=True)
    inside = Window.partitionBy(*by, "_slice").orderBy(F.col("_head").desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in along])
    before = F.lag(F.when(F.col("_head"), F.col("_before")).otherwise(held)).over(inside)
    out = stacked.withColumn("_found", before).filter(F.col("_head").isNull())
    return out.select(*df.columns, *[F.col(f"_found.{n}").alias(n) for n in columns])
