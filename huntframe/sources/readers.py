"""Scans."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntframe.functions.durations import time_literal


def scan(spark: SparkSession, table: str) -> DataFrame:
    """A registered event table or view."""
    return spark.table(table)


def scan_events(spark: SparkSession, path: str, start: datetime | None = None,
                stop: datetime | None = None, time: str = "TimeGenerated",
                day: str = "event_date") -> DataFrame:
    """Events stored by day; a time range also prunes the day folders."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.filter((F.col(day) >= F.lit(start.date())) & (F.col(time) >= time_literal(start)))
    if stop is not None:
        df = df.filter((F.col(day) <= F.lit(stop.date())) & (F.col(time) < time_literal(stop)))
    return df


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON Lines under a declared schema; a path that is not there reads as empty."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan_json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Files that each hold one JSON document (an object, or an array of objects)."""
    return (spark.read.schema(schema).option("multiLine", True)
            .option("recursiveFileLookup", True).json(path))


def scan_whole_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Every matching file below a folder as one row: its path and its whole text."""
    files = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
             .text(path, wholetext=True))
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def scan_field_rows(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """Field names of markdown field tables: lines of the form ``| **Name** | ...``."""
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path))
    name = F.regexp_extract(F.trim("value"), r"^\|\s*\*\*([A-Za-z0-9]+)\*\*\s*\|", 1)
    found = lines.select(F.col("_metadata.file_name").alias("document"), name.alias("field"))
    return found.filter(F.col("field") != "")
