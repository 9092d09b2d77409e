"""A value worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))
