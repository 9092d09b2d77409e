"""Helpers that keep one heavy group from landing in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_SHARE = 1 / 64


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the left keys are kept."""
    if not keys:
        raise ValueError("null_safe_join needs keys")
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"_r_{k}" for k in keys])


def merge_by_key(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Bring per-group results together: frames with one row per group and their own value columns.

    Works by union and one more grouping of the already small group rows, so null keys need no
    special join and no frame is broadcast.
    """
    if len(frames) == 1:
        return frames[0]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    values = [c for c in stacked.columns if c not in keys]
    merged = stacked.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in values])
    return merged


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE, counted: bool = False) -> DataFrame:
    """Keys that hold at least ``share`` of the rows; never more than ``1/share`` rows."""
    if share < 1 / 4096:
        raise ValueError("a smaller share would make the list of hot keys too long to send around")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    found = counts.filter(F.col("_n") >= F.lit(share) * total.scalar())
    return found if counted else found.drop("_n")


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, salts: int = 32,
                share: float = HOT_SHARE, null_safe: bool = False) -> DataFrame:
    """Join whose left side (of an inner join, either side) may hold a third of its rows under one key.

    Rows of a hot key are spread over ``salts`` groups and only their partners on the other side are
    repeated. The hot-key table has at most ``2/share`` rows, so sending it to every task is safe.
    The group of a row is a hash of its columns, so project to the needed columns first. Valid for
    inner, left, left_semi and left_anti.
    """
    def on(a: DataFrame, b: DataFrame, names: list[str], kind: str) -> DataFrame:
        return null_safe_join(a, b, names, kind) if null_safe else a.join(b, names, kind)

    hot = hot_keys(left, keys, share, True).withColumn("_hot", F.lit("left"))
    if how == "inner":
        # A key may be frequent on the right: its rows are spread on the side that has more of them.
        hot = hot.union(hot_keys(right, keys, share, True).withColumn("_hot", F.lit("right"))).groupBy(*keys).agg(
            F.max_by("_hot", "_n").alias("_hot"))
    else:
        hot = hot.drop("_n")
    hot = F.broadcast(hot)  # at most 2 / share rows

    def salted(df: DataFrame, own: str) -> DataFrame:
        hashable = [f.name for f in df.schema.fields if not holds_map(f.dataType)]
        salt = F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int")
        spread = F.col("_hot") == own
        if own == "left" and not null_safe:
            # Rows with a missing key meet no partner, so they may go anywhere.
            spread = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys], spread)
        everywhere = F.sequence(F.lit(0), F.lit(salts - 1))
        places = F.when(spread, F.array(salt)).when(F.col("_hot").isNull(), F.array(F.lit(0))).otherwise(everywhere)
        return on(df, hot, keys, "left").withColumn("_salt", F.explode(places)).drop("_hot")

    return on(salted(left, "left"), salted(right, "right"), [*keys, "_salt"], how).drop("_salt")


PAIRS = 1 << 25  # that one group of a balanced join may form
MOST_SPLIT = 4096  # keys that a balanced join splits


def balanced_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of two sides whose rows of a key form many pairs; the left keys are kept.

    The pairs of each key are counted first. A key with more than ``PAIRS`` is split into that many groups: the side that
    has more rows of it is dealt over them by a hash of its columns, the other side's rows are repeated in each. The
    ``MOST_SPLIT`` keys with the most pairs are split, so their list may be sent to every task. Nothing else is broadcast,
    whatever the planner takes the sides for, and the number of partitions is named: small sides can form many pairs.
    """
    n, m = F.col("_n"), F.col("_m")
    groups = F.ceil(n * m / F.lit(float(PAIRS))).cast("int")
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).hint("merge").join(
        right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")), keys)
    large = counts.select(*keys, (n >= m).alias("_deal_left"), F.least(groups, F.greatest(n, m)).cast("int").alias("_groups"))
    split = F.broadcast(large.filter("_groups > 1").orderBy(F.desc("_groups"), *keys).limit(MOST_SPLIT))
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame, own: Column) -> DataFrame:
        hashable = [f.name for f in df.schema.fields if not holds_map(f.dataType)]
        one = F.array(F.pmod(F.xxhash64(*hashable), F.col("_groups")).cast("int"))
        places = F.when(F.col("_groups").isNull(), F.array(F.lit(0))).when(own, one).otherwise(
            F.sequence(F.lit(0), F.col("_groups") - 1))
        placed = df.join(split, keys, "left").withColumn("_group", F.explode(places)).drop("_groups", "_deal_left")
        return placed.repartition(parts, *keys, "_group")

    deal_left = F.col("_deal_left")
    return dealt(left, deal_left).hint("merge").join(dealt(right, ~deal_left), [*keys, "_group"]).drop("_group")


def holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(holds_map(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return holds_map(kind.elementType)
    return isinstance(kind, (T.MapType, T.VariantType))


def rank_within(df: DataFrame, keys: list[str], order: list[Column], bucket: Column,
                rank: str = "rank") -> DataFrame:
    """Adds each row's 1-based position in its group, and the group's size as ``<rank>_of``.

    ``bucket`` must grow with ``order``. Rows are sorted only within (group, bucket); what comes
    before a bucket is known from the bucket counts. A group is never sorted in one task. The counts
    travel as one leading row per bucket, so the rows are shuffled once and not joined.
    """
    cut = df.withColumn("_bucket", bucket)
    parts = [*keys, "_bucket"]
    sizes = cut.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    heads = sizes.select(
        *parts, F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias(f"{rank}_of"), F.lit(True).alias("_head"))
    stacked = cut.unionByName(heads, allowMissingColumns=True)
    inside = Window.partitionBy(*parts).orderBy(F.col("_head").desc_nulls_last(), *order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stacked.withColumns({
        rank: F.first("_before", ignorenulls=True).over(so_far) + F.row_number().over(inside) - 1,
        f"{rank}_of": F.first(f"{rank}_of", ignorenulls=True).over(so_far),
    }).filter(F.col("_head").isNull()).drop("_bucket", "_before", "_head")


_STEP = 32  # cut points are looked up in two rounds of 32, for 32 * 32 buckets


def _bucket_of(cuts: Column, value: Column) -> Column:
    """How many of the 1023 sorted cut points lie below a value, by one coarse and one fine round."""
    coarse = F.size(F.filter(cuts["steps"], lambda c: c < value))
    fine = F.size(F.filter(F.get(cuts["between"], coarse), lambda c: c < value))
    return coarse * _STEP + fine


def _even_cuts(values: DataFrame, keys: list[str]) -> DataFrame:
    """One row with 1023 cut points over a column ``_v`` of numbers, from bounded sketches."""
    # As one folded text literal: a thousand separate literals would slow the planner down.
    shares = F.split(F.lit(",".join(str(i / _STEP**2) for i in range(1, _STEP**2))), ",").cast("array<double>")
    # Cut points need only be roughly even, so a sketch of a few short sketches will do; none sees everything.
    parts = values.groupBy(F.pmod(F.xxhash64("_v", *keys), F.lit(64)).alias("_part")).agg(
        F.percentile_approx("_v", shares, 2_000).alias("some"))
    sketch = parts.select(F.explode("some").alias("_v")).agg(F.percentile_approx("_v", shares, 10_000).alias("all"))
    return sketch.select(F.struct(
        F.filter("all", lambda _, i: F.pmod(i + 1, F.lit(_STEP)) == 0).alias("steps"),
        F.transform(F.sequence(F.lit(0), F.lit(_STEP - 1)), lambda k: F.slice(
            "all", k * _STEP + 1, F.lit(_STEP - 1))).alias("between")))


def exact_percentiles(df: DataFrame, keys: list[str], field: Column, points: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated percentiles per group, whatever the size of a group.

    Values are first counted per (group, value). 1023 cut points over all values, from a bounded
    sketch, then split each group into ranges; the counts per range tell which one holds the wanted
    position, and only that one is sorted. A group with a third of all rows has about a thousandth
    of them in a range.
    """
    number = field.try_cast("double")
    values = df.select(*keys, number.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    counted = values.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    cuts = _even_cuts(counted, keys)
    counted = counted.withColumn("_cuts", cuts.scalar())
    counted = counted.withColumn("_b", _bucket_of(F.col("_cuts"), F.col("_v"))).drop("_cuts")

    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counted.groupBy(*keys, "_b").agg(F.sum("_n").alias("_size")).select(
        *keys, "_b", "_size",
        F.coalesce(F.sum("_size").over(upto), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy(*keys)).alias("_total"))

    def position(p: float) -> Column:
        return F.lit(p / 100.0) * (F.col("_total") - 1)

    def covers(rank: Column, start: Column, size: Column) -> Column:
        return (start <= rank) & (rank < start + size)

    wanted = reduce(lambda a, b: a | b, [
        covers(r, F.col("_before"), F.col("_size"))
        for p in points.values() for r in (F.floor(position(p)), F.ceil(position(p)))])
    targets = sizes.filter(wanted).select(*keys, "_b", "_before", "_total")
    near = null_safe_join(counted, targets, [*keys, "_b"])
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = near.withColumn("_start", F.col("_before") + F.sum("_n").over(inside) - F.col("_n"))

    def value_at(rank: Column) -> Column:
        return F.max(F.when(covers(rank, F.col("_start"), F.col("_n")), F.col("_v")))

    found = placed.groupBy(*keys).agg(
        F.max("_total").alias("_total"),
        *[value_at(F.floor(position(p))).alias(f"_lo_{a}") for a, p in points.items()],
        *[value_at(F.ceil(position(p))).alias(f"_hi_{a}") for a, p in points.items()])

    def interpolated(alias: str, p: float) -> Column:
        low, high = F.col(f"_lo_{alias}"), F.col(f"_hi_{alias}")
        return low + (high - low) * (position(p) - F.floor(position(p)))

    return found.select(*keys, *[interpolated(a, p).alias(a) for a, p in points.items()])


def running_totals(df: DataFrame, order: str, totals: dict[str, str]) -> DataFrame:
    """Adds, under each alias, the sum of a column over all rows up to and with this one, along a numeric column.

    Values of ``order`` must differ and be numbers. Rows are sorted only within 1024 ranges cut by a bounded
    sketch; what comes before a range is known from the sums per range, at most 1024 rows. No task sees all rows.
    """
    rows = df.withColumn("_v", F.col(order).cast("double"))
    cut = rows.withColumn("_cuts", _even_cuts(rows, [order]).scalar())
    cut = cut.withColumn("_b", _bucket_of(F.col("_cuts"), F.col("_v"))).drop("_cuts", "_v")
    upto = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("_b").agg(*[F.sum(c).alias(f"_sum_{a}") for a, c in totals.items()]).select(
        "_b", *[F.coalesce(F.sum(f"_sum_{a}").over(upto), F.lit(0)).alias(f"_before_{a}") for a in totals])
    inside = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.withColumns({f"_own_{a}": F.sum(c).over(inside) for a, c in totals.items()}).join(sizes, "_b")
    return placed.select(*df.columns, *[(F.col(f"_own_{a}") + F.col(f"_before_{a}")).alias(a) for a in totals])
