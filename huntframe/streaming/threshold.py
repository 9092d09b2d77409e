"""The per-entity threshold on a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntframe.functions.durations import duration_micros


def threshold_stream(events: DataFrame, by: list[str], every: str, threshold: int,
                     time: str = "TimeGenerated", late: str = "PT10M",
                     distinct: str | None = None) -> DataFrame:
    """Entities with more than ``threshold`` events (or, approximately, distinct values) per time bin.

    For append output: a bin is reported once the watermark has passed its end, and its state is
    dropped then. State is one counter (or one sketch) per entity and open bin.
    """
    def text(duration: str) -> str:
        return f"{duration_micros(duration)} microseconds"

    measure = F.approx_count_distinct(distinct) if distinct else F.count(F.lit(1))
    counted = (events.withWatermark(time, text(late))
               .groupBy(F.window(time, text(every)).alias("_bin"), *by).agg(measure.alias("n")))
    return counted.filter(F.col("n") > threshold).select(F.col("_bin.start").alias(time), *by, "n")
