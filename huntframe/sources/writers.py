"""Sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_events(df: DataFrame, path: str, time: str = "TimeGenerated", day: str = "event_date") -> None:
    """Store events by day, the layout ``scan_events`` prunes.

    Rows are brought together by day first, large days in several files, so that not every task
    writes a small file for every day.
    """
    dated = df.withColumn(day, F.to_date(time)).hint("rebalance", F.col(day))
    dated.write.mode("overwrite").partitionBy(day).parquet(path)


# Times keep their microseconds in JSON text.
_JSON_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
               "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_JSON_TIMES).json(path)


def write_routed(df: DataFrame, path: str, accepted: Column, route: str = "is_normalized") -> None:
    """Send each row to one of two folders by a test, in one pass over the input."""
    routed = df.withColumn(route, F.coalesce(accepted, F.lit(False)))
    routed.write.mode("overwrite").options(**_JSON_TIMES).partitionBy(route).json(path)


def append_results(results: DataFrame, path: str, key: str) -> DataFrame:
    """Append the results whose key is not in the table yet, so an interrupted run can go on."""
    try:
        done = results.sparkSession.read.parquet(path).select(key).distinct()
        results = results.join(done, key, "left_anti")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
    results.write.mode("append").parquet(path)
    return results.sparkSession.read.parquet(path)


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what a stream yields from all input there is now to a parquet folder, and ends.

    The position and the state lie in ``checkpoint``: the next call goes on from there, and one that was interrupted is
    repeated without writing rows twice.
    """
    (stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
