"""Session windows and sliding windows, without one entity in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huntframe.functions.durations import duration_micros, floor_div, from_micros, micros_of
from huntframe.operators.skew import merge_by_key


def mark_sessions(df: DataFrame, by: list[str], time: str, gap: str, every: str | None = None, start: str = "session_start") -> DataFrame:
    """Adds the start of the session each row belongs to: sessions end where the next row is more than ``gap`` later.

    A group is cut into slices of ``every`` (the gap, if not given). Inside a slice the gaps are found from row to row;
    across slices, from the first and last times of the slices, a row per slice. Rows without a time have no session.
    """
    width, most = duration_micros(every or gap), duration_micros(gap)
    kind = df.schema[time].dataType.simpleString()
    part = [*by, "_slice"]
    cut = df.withColumn("_at", micros_of(F.col(time))).withColumn("_slice", floor_div(F.col("_at"), width))
    inside = Window.partitionBy(*part).orderBy("_at")
    apart = F.col("_at") - F.lag("_at").over(inside) > most
    opened = cut.filter("_at is not null").select(*part, "_at", F.when(apart, F.col("_at")).alias("_opens"))
    slices = opened.groupBy(*part).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.max("_opens").alias("_opens"))
    along = Window.partitionBy(*by).orderBy("_slice")
    fresh = F.coalesce(F.col("_first") - F.lag("_last").over(along) > most, F.lit(True))
    slices = slices.withColumn("_own", F.when(fresh, F.col("_first")))
    carried = F.max(F.coalesce("_opens", "_own")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    heads = slices.select(*part, F.coalesce("_own", carried).alias("_session"), F.lit(True).alias("_head"))
    stacked = cut.unionByName(heads, allowMissingColumns=True)
    ordered = Window.partitionBy(*part).orderBy(F.col("_head").desc_nulls_last(), "_at")
    gone_by = F.col("_at") - F.lag("_at").over(ordered) > most
    marked = stacked.withColumn("_session", F.when(F.col("_head"), F.col("_session")).when(gone_by, F.col("_at")))
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("_session", F.last("_session", ignorenulls=True).over(so_far)).filter(F.col("_head").isNull())
    found = F.when(F.col("_at").isNotNull(), from_micros(F.col("_session"), kind))
    return marked.select(*df.columns, found.alias(start))


_MERGED = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def sliding(df: DataFrame, by: list[str], time: str, every: str, span: str, start: str | None = None, **measures) -> DataFrame:
    """Aggregates over windows of length ``span`` that begin every ``every``, one row per group and window with rows.

    ``measures`` maps names to ``"count"`` or pairs of ``"count"`` (values that are there), ``"sum"``, ``"min"``, ``"max"``,
    ``"avg"`` or ``"dcount"`` (exact, of different values) and a column: ``n="count", users=("dcount", "user_id")``.
    ``start`` names the column of the window's begin, the time column's name if not given.

    Each row is counted once, in its pane of length ``every``; panes are then merged into the windows they lie in, so
    what is repeated is at most a row per group and pane. Different values are counted by where a value comes into and
    leaves the windows. Rows without a time take no part.
    """
    step, length = duration_micros(every), duration_micros(span)
    if length % step:
        raise ValueError("the span must be a multiple of the step")
    panes = length // step
    kind = df.schema[time].dataType.simpleString()
    keys = list(by)
    placed = df.withColumn("_pane", floor_div(micros_of(F.col(time)), step)).filter("_pane is not null")
    asked = {name: (m, None) if isinstance(m, str) else m for name, m in measures.items()}

    partial, merged, final = [F.count(F.lit(1)).alias("_rows")], [], []
    for name, (measure, column) in asked.items():
        if measure == "dcount":
            final.append(F.coalesce(name, F.lit(0).cast("long")).alias(name))
        elif measure == "avg":
            partial += [F.sum(column).alias(f"_sum_{name}"), F.count(column).alias(f"_count_{name}")]
            merged += [F.sum(f"_sum_{name}").alias(f"_sum_{name}"), F.sum(f"_count_{name}").alias(f"_count_{name}")]
            final.append((F.col(f"_sum_{name}") / F.nullif(F.col(f"_count_{name}"), F.lit(0))).alias(name))
        elif measure in _MERGED:
            own = F.count(F.lit(1) if column is None else column) if measure == "count" else getattr(F, measure)(column)
            partial.append(own.alias(f"_{name}"))
            merged.append(_MERGED[measure](f"_{name}").alias(f"_{name}"))
            final.append(F.col(f"_{name}").alias(name))
        else:
            raise ValueError(f"unknown measure {measure!r}")

    begins = F.explode(F.sequence(F.col("_pane") - (panes - 1), F.col("_pane"))).alias("_window")
    per_pane = placed.groupBy(*keys, "_pane").agg(*partial)
    windows = per_pane.select("*", begins).groupBy(*keys, "_window").agg(F.sum("_rows").alias("_rows"), *merged)
    frames = [windows]
    for name, (measure, column) in asked.items():
        if measure == "dcount":
            frames.append(_different(placed, windows, keys, column, panes, name))
    return merge_by_key(frames, [*keys, "_window"]).select(
        *keys, from_micros(F.col("_window") * step, kind).alias(start or time), *final)


def _different(placed: DataFrame, windows: DataFrame, keys: list[str], column: str, panes: int, name: str) -> DataFrame:
    """How many different values each window has: a value in a pane adds one to the windows that begin up to ``panes``
    panes before and do not hold it already."""
    values = placed.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_value"), "_pane").agg(F.lit(1).alias("_one"))
    last = F.lag("_pane").over(Window.partitionBy(*keys, "_value").orderBy("_pane"))
    first = F.greatest(F.col("_pane") - (panes - 1), F.col("_before") + 1)
    changes = values.withColumn("_before", last).select(*keys, F.explode(F.array(
        F.struct(first.alias("_window"), F.lit(1).cast("long").alias("_change")),
        F.struct((F.col("_pane") + 1).alias("_window"), F.lit(-1).cast("long").alias("_change")))).alias("_c")).select(*keys, "_c.*")
    net = changes.groupBy(*keys, "_window").agg(F.sum("_change").alias("_change"))
    stacked = net.unionByName(windows.select(*keys, "_window", F.lit(True).alias("_asked")), allowMissingColumns=True)
    running = Window.partitionBy(*keys).orderBy("_window").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return stacked.withColumn(name, F.sum("_change").over(running)).filter("_asked").select(
        *keys, "_window", F.coalesce(name, F.lit(0).cast("long")).alias(name))
