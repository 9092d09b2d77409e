"""Durations, relative times and tumbling time bins."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = {"day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000}
_LETTER = {"D": "day", "H": "hour", "M": "minute", "S": "second"}


def duration_micros(duration: str | timedelta) -> int:
    """Microseconds in an ISO-8601 duration of days, hours, minutes and seconds (``P1DT2H``)."""
    if isinstance(duration, timedelta):
        return duration // timedelta(microseconds=1)
    days, _, clock = duration[1:].partition("T")
    valid = (
        duration.startswith("P")
        and re.fullmatch(r"(\d+D)?", days)
        and re.fullmatch(r"(\d+H)?(\d+M)?(\d+S)?", clock)
    )
    total = sum(int(n) * MICROS[_LETTER[u]] for n, u in re.findall(r"(\d+)([DHMS])", duration))
    if not valid or not total:
        raise ValueError(f"not a day/hour/minute/second duration: {duration!r}")
    return total


def ago(as_of: datetime, span: str) -> datetime:
    """``as_of`` minus a span such as ``7d``, ``12h``, ``30m`` or ``45s``."""
    number, unit = int(span[:-1]), span[-1].upper()
    return as_of - timedelta(microseconds=number * MICROS[_LETTER[unit]])


def epoch_micros(moment: datetime) -> int:
    """Microseconds since the epoch; a naive datetime is read as UTC."""
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return (moment - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def time_literal(moment: datetime) -> Column:
    """A literal of the matching kind: naive gives timestamp_ntz, aware gives timestamp.

    Comparing a column with a literal of its own kind keeps the comparison in the parquet scan.
    """
    if moment.tzinfo is None:
        return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
    utc = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(utc.isoformat(sep=" ") + "Z").cast("timestamp")


def micros_of(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


def from_micros(col: Column, kind: str = "timestamp") -> Column:
    return F.timestamp_micros(col).cast(kind)


def floor_div(a: Column, width: int) -> Column:
    """Integer floor division that also holds for negative numbers."""
    return ((a - F.pmod(a, F.lit(width))) / F.lit(width)).cast("long")


def time_bin(col: Column, width: str | timedelta, origin: datetime | None = None,
             kind: str = "timestamp") -> Column:
    """Start of the tumbling bin a time falls in; null stays null.

    Bins are counted from ``origin`` (the epoch by default). Widths that do not divide a day,
    and multi-day widths, move with the origin.
    """
    step = duration_micros(width)
    shift = epoch_micros(origin) % step if origin else 0
    ticks = micros_of(col)
    return from_micros(ticks - F.pmod(ticks - F.lit(shift), F.lit(step)), kind)
