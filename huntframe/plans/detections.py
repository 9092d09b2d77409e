"""Ready-made detections, composed from the operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.functions import predicates as P
from huntframe.functions.durations import duration_micros, micros_of, time_literal
from huntframe.functions.scalars import datetime_diff, divide, ipv4_is_private
from huntframe.operators.aggregates import (
    Agg, arg_max, arg_min, avg, count, dcount, distinct_items, make_set, maximum, minimum,
    percentile, stdev, summarize,
)
from huntframe.operators.joins import join, within_span
from huntframe.operators.series import expand_series, make_series, series_anomaly
from huntframe.operators.stages import extend, parse, top, where

TIME = "TimeGenerated"


def threshold_per_entity(df: DataFrame, by: list[str], every: str, threshold: int, time: str = TIME,
                         distinct: str | None = None, approx: bool = False) -> DataFrame:
    """Entities with more than ``threshold`` events (or distinct values) in one time bin."""
    measure = dcount(distinct, approx) if distinct else count()
    return where(summarize(df, by, every=every, time=time, n=measure), P.gt("n", threshold))


def baseline_vs_current(df: DataFrame, by: list[str], as_of: datetime, margin: float, time: str = TIME,
                        current: str = "P1D", baseline: str = "P14D") -> DataFrame:
    """Entities whose current count exceeds their average per period of the baseline by ``margin``.

    One pass: both counts are conditional sums over the baseline range.
    """
    ticks, now = micros_of(F.col(time)), micros_of(time_literal(as_of))
    periods = duration_micros(baseline) / duration_micros(current)
    recent = df.filter((ticks >= now - F.lit(duration_micros(baseline))) & (ticks < now))
    is_current = ticks >= now - F.lit(duration_micros(current))
    counts = recent.groupBy(*by).agg(
        F.count_if(is_current).alias("CurrentCount"), F.count(F.lit(1)).alias("BaselineCount"))
    return where(
        extend(counts.filter("CurrentCount > 0"),
               BaselineAvg=F.col("BaselineCount") / F.lit(float(periods)),
               Margin=F.col("CurrentCount") - F.col("BaselineAvg")),
        F.col("Margin") > margin)


def ordered_pair(df: DataFrame, by: list[str], first: Column, then: Column, unit: str = "minute",
                 within: float = 60, time: str = TIME) -> DataFrame:
    """Entities whose first ``then`` event follows their first ``first`` event within the window."""
    times = df.filter(first | then).groupBy(*by).agg(
        F.min(F.when(first, F.col(time))).alias("FirstTime"),
        F.min(F.when(then, F.col(time))).alias("ThenTime"))
    gap = extend(times, Between=datetime_diff(unit, "ThenTime", "FirstTime"))
    return gap.filter((F.col("Between") > 0) & (F.col("Between") <= within))


def rare_entities(df: DataFrame, by: list[str], point: float) -> DataFrame:
    """Entities whose frequency is at or below a percentile of all entities' frequencies."""
    frequency = summarize(df, by, Frequency=count())
    limit = summarize(frequency, Limit=percentile("Frequency", point))
    return frequency.withColumn("Limit", limit.scalar()).filter(F.col("Frequency") <= F.col("Limit"))


def inside_activity_span(events: DataFrame, activity: DataFrame, on: list[str], time: str = TIME,
                         salts: int = 0) -> DataFrame:
    """Events between the first and the last activity of the same entity."""
    spans = summarize(activity, on, FirstSeen=minimum(time), LastSeen=maximum(time))
    return within_span(events, spans, on, time, "FirstSeen", "LastSeen", salts=salts)


def regularity(df: DataFrame, by: list[str], every: str, below: float, time: str = TIME) -> DataFrame:
    """Entities whose counts per time bin vary little: deviation over mean below a bound."""
    per_bin = summarize(df, by, every=every, time=time, Count=count())
    spread = summarize(per_bin, by, Deviation=stdev("Count"), Average=avg("Count"), Bins=count())
    return extend(spread, Variation=divide("Deviation", "Average")).filter(F.col("Variation") < below)


def outlier_buckets(df: DataFrame, by: list[str], start: datetime, stop: datetime, step: str,
                    measure: Agg, threshold: float = 1.5, time: str = TIME) -> DataFrame:
    """Time buckets that stand out in an entity's own history."""
    series = make_series(df, start, stop, step, by, time, Value=measure)
    scored = series_anomaly(series, "Value", threshold)
    rows = expand_series(scored, time, "Value", "AnomalyFlag", "AnomalyScore", "Baseline")
    return rows.filter(F.col("AnomalyFlag") != 0)


def latest_row(df: DataFrame, by: list[str], time: str = TIME, first: str | None = None,
               every: str | None = None) -> DataFrame:
    """The whole latest row per entity (and time bin)."""
    # The picked row's own time stays; the bin start is dropped.
    return summarize(df, by, every=every, time=time, keep_bin=False,
                     picks=(arg_max(time, "*", first=first),))


def first_row(df: DataFrame, by: list[str], time: str = TIME, first: str | None = None,
              every: str | None = None) -> DataFrame:
    return summarize(df, by, every=every, time=time, keep_bin=False,
                     picks=(arg_min(time, "*", first=first),))


def active_indicators_seen(indicators: DataFrame, activity: DataFrame, indicator_key: str, active: Column,
                           on: str, time: str = TIME, first: str | None = None,
                           salts: int = 0) -> DataFrame:
    """Activity on indicators whose latest version is active."""
    latest = latest_row(indicators, [indicator_key], time, first).filter(active)
    return join(activity, latest, [on], "inner", salts=salts)


def renamed_tool(df: DataFrame, command: str, flags: list[str], name: str, tool: str) -> DataFrame:
    """All of a tool's flags present although the program is not named like the tool."""
    return where(df, P.has_all(command, flags), P.not_endswith(name, tool))


def category_mismatch(df: DataFrame, category: str, value: str, expected: dict) -> DataFrame:
    """Rows of a listed category whose value is not the one that category should have."""
    return where(df, P.any_of(*[
        P.all_of(P.eq(category, k), P.ne(value, v)) for k, v in expected.items()]))


def first_seen(df: DataFrame, by: list[str], since: datetime, history_from: datetime,
               time: str = TIME) -> DataFrame:
    """Entities present since an instant and absent from the history before it, in one pass."""
    recent = F.col(time) >= time_literal(since)
    ranged = df.filter(F.col(time) >= time_literal(history_from))
    seen = ranged.groupBy(*by).agg(
        F.min(F.when(recent, F.col(time))).alias("FirstSeen"),
        F.max(F.when(recent, F.col(time))).alias("LastSeen"),
        F.count_if(~recent).alias("_history"))
    return seen.filter("FirstSeen IS NOT NULL AND _history = 0").drop("_history")


def extract_and_count(df: DataFrame, source: str, template: tuple, by: str, threshold: int) -> DataFrame:
    """Cut a value out of text and report values that occur more than ``threshold`` times."""
    found = parse(df, source, *template).filter(F.col(by).isNotNull())
    return where(summarize(found, [by], n=count()), P.gt("n", threshold))


def touched_items(df: DataFrame, by: list[str], item: str, test: Column, every: str | None = None,
                  time: str = TIME) -> DataFrame:
    """Distinct items per entity that pass a test.

    Same rows as collecting a set, expanding and filtering it, without an array per entity.
    """
    return distinct_items(df.filter(test), by, item) if every is None else \
        summarize(df.filter(test), [*by, item], every=every, time=time)


def external_to_ports(df: DataFrame, address: str, port: str, ports: list[int]) -> DataFrame:
    return where(extend(df, IsExternal=~ipv4_is_private(address)),
                 F.col("IsExternal"), P.in_(port, ports))


def noisiest(df: DataFrame, by: list[str], n: int) -> DataFrame:
    return top(summarize(df, by, n=count()), n, "n", tiebreak=tuple(by))


def inventory(df: DataFrame, by: list[str], time: str = TIME) -> DataFrame:
    return summarize(df, by, n=count(), FirstSeen=minimum(time), LastSeen=maximum(time))


def threshold_with_evidence(df: DataFrame, by: list[str], threshold: int, evidence: str, limit: int,
                            order: tuple[str, ...], every: str | None = None,
                            time: str = TIME) -> DataFrame:
    """Entities over a count, with what they touched and when, the count not split by evidence."""
    result = summarize(df, by, every=every, time=time, n=count(),
                       Evidence=make_set(evidence, limit, order),
                       FirstSeen=minimum(order[0]), LastSeen=maximum(order[0]))
    return where(result, P.gt("n", threshold))


def two_term_sets(df: DataFrame, field: str, one_of: list[str], and_one_of: list[str]) -> DataFrame:
    return where(df, P.has_any(field, one_of), P.has_any(field, and_one_of))


def fragment_and_flag(df: DataFrame, field: str, fragment: str, flag: str) -> DataFrame:
    """An exact-case fragment together with a flag in any case."""
    return where(df, P.has(field, flag), P.contains_cs(field, fragment))


def many_values(df: DataFrame, by: list[str], field: str, at_least: int, limit: int,
                order: tuple[str, ...] = ()) -> DataFrame:
    result = summarize(df, by, Distinct=dcount(field), Values=make_set(field, limit, order))
    return where(result, P.ge("Distinct", at_least))
