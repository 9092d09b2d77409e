"""Ordered pairs and first sightings on a stream of events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.functions.durations import duration_micros


def _span(micros: int) -> Column:
    return F.expr(f"INTERVAL '{micros}' MICROSECOND")


def _delay(duration: str) -> str:
    return f"{duration_micros(duration)} microseconds"


def followed_stream(events: DataFrame, by: list[str], first: Column, then: Column, within: str, time: str = "TimeGenerated",
                    late: str = "PT10M", key: str | None = None, salts: int = 1) -> DataFrame:
    """The ``then`` events that have a ``first`` event of the same entity before them, at most ``within`` earlier.

    For append output. An event is reported once, as soon as one ``first`` event is known, whichever of both arrives
    first; pairs are never built. Events more than ``late`` behind the latest time seen are left out. With ``key``, the
    name of an event, one that is delivered again within ``late`` counts once. State is dropped by time: a ``first``
    event once no later ``then`` event can reach it, a ``then`` event once no ``first`` event can still come before it.
    Events without a time or an entity key take no part. ``salts`` spreads the ``then`` events of one entity over that
    many tasks and repeats its ``first`` events there.
    """
    marked = events.filter(first | then).withWatermark(time, _delay(late))
    if key is not None:
        marked = marked.dropDuplicatesWithinWatermark([key])
    salt = F.pmod(F.xxhash64(F.col(time), *by), F.lit(salts)).cast("int")
    later = marked.filter(then).withColumn("_salt", salt)
    earlier = marked.filter(first).select(
        *[F.col(c).alias(f"_first_{c}") for c in by], F.col(time).alias("_first_time"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_first_salt"))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_first_{c}") for c in by])
    met = same & (F.col("_salt") == F.col("_first_salt")) & (F.col(time) > F.col("_first_time")) & (
        F.col(time) <= F.col("_first_time") + _span(duration_micros(within)))
    return later.join(earlier, met, "left_semi").drop("_salt")


def first_seen_stream(events: DataFrame, by: list[str], every: str, history: str, time: str = "TimeGenerated",
                      late: str = "PT10M") -> DataFrame:
    """Entities seen in a time bin and in none of the bins of the ``history`` before it: bin start, entity, FirstSeen, LastSeen, n.

    For append output: a bin is reported once the watermark has passed its end. ``history`` is a whole number of bins.
    State is one row per entity and bin it was seen in, as far back as ``history``; a busy entity is pre-aggregated
    before it is shuffled. Events without a time or with a null in ``by`` take no part.
    """
    step, back = duration_micros(every), duration_micros(history)
    if back % step:
        raise ValueError("history must be a whole number of bins")
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by])

    def bins() -> DataFrame:
        return (events.filter(known).withWatermark(time, _delay(late)).groupBy(F.window(time, f"{step} microseconds").alias("_bin"), *by)
                .agg(F.min(time).alias("FirstSeen"), F.max(time).alias("LastSeen"), F.count(F.lit(1)).alias("n"))
                .withColumn("_at", F.window_time("_bin")))

    now = bins()
    before = bins().select(*[F.col(c).alias(f"_before_{c}") for c in by], F.col("_at").alias("_before_at"))
    met = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_before_{c}") for c in by])
    met &= (F.col("_before_at") < F.col("_at")) & (F.col("_before_at") >= F.col("_at") - _span(back))
    fresh = now.join(before, met, "left_outer").filter(F.col("_before_at").isNull())
    return fresh.select(F.col("_bin.start").alias(time), *by, "FirstSeen", "LastSeen", "n")
