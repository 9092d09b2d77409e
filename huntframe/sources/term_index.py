"""A stored index from terms to the rows that hold them, for whole-term tests with long lists of terms.

Terms are stored in bands, each a range of terms in files of its own, so a look-up reads only the bands of its terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.functions.predicates import has
from huntframe.operators.joins import join

MOST_BANDS = 4096  # the list of bands passes through the driver

_OTHER = "[^a-z0-9_]"


def _entries(subject: Column) -> Column:
    """What a text in small letters is found by: its words of ASCII letters, digits and ``_``, and each other character."""
    return F.array_remove(F.array_distinct(F.concat(F.split(subject, f"{_OTHER}+"), F.split(F.regexp_replace(
        subject, "[a-z0-9_]+", ""), ""))), "")


def write_term_index(df: DataFrame, key: str, text: str, path: str, bands: int = 256) -> None:
    """Store which terms the text of each row holds. ``key`` names a row; rows of one key count as one.

    Rows without a key or text are not found later. The entries are sorted by term over all files; the rows of a very
    frequent term lie in several bands. The entries are stored unsorted first: the ranges are cut by a look at all of them,
    and the texts are taken apart only once.
    """
    if not 1 <= bands <= MOST_BANDS:
        raise ValueError(f"between 1 and {MOST_BANDS} bands")
    entries = df.filter(F.col(key).isNotNull()).select(
        F.explode(_entries(F.lower(F.col(text).cast("string")))).alias("term"), F.col(key).alias("key"))
    entries.write.mode("overwrite").parquet(f"{path}/entries")
    entries = df.sparkSession.read.schema(entries.schema).parquet(f"{path}/entries")
    placed = entries.repartitionByRange(bands, "term", "key").withColumn("band", F.spark_partition_id())
    placed.sortWithinPartitions("band", "term").write.mode("overwrite").partitionBy("band").parquet(f"{path}/terms")
    stored = df.sparkSession.read.schema(f"term string, key {df.schema[key].dataType.simpleString()}, band int").parquet(f"{path}/terms")
    stored.groupBy("band").agg(F.min("term").alias("first"), F.max("term").alias("last"), F.min("key").alias("key")).coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/bands")


def _probed(terms: DataFrame, term: str) -> DataFrame:
    """Different terms in small letters, with the entry they are looked up by (the longest word, else a character)
    and whether that entry is the whole term."""
    wanted = terms.select(F.lower(F.col(term).cast("string")).alias("wanted")).filter("wanted <> ''").distinct()
    longest = F.array_max(F.transform(_entries(F.col("wanted")), lambda e: F.struct(F.length(e).alias("n"), e.alias("e"))))
    return wanted.withColumn("term", longest["e"]).withColumn("whole", (F.col("term") == F.col("wanted")) & ~F.col("term").rlike(_OTHER))


def look_up(spark: SparkSession, path: str, probes: DataFrame, salts: int = 0) -> DataFrame:
    """Entries of the index for the terms of ``probes`` (column ``term``), with its other columns.

    Only bands in whose range one of the terms lies are read: the plan lists them as a partition filter.
    """
    known = spark.read.parquet(f"{path}/bands").limit(MOST_BANDS)
    ranges = known.agg(F.collect_list(F.struct("band", "first", "last")).alias("ranges")).select("ranges").scalar()
    hit = F.filter("_ranges", lambda r: (r["first"] <= F.col("term")) & (F.col("term") <= r["last"]))
    touched = probes.select("term", ranges.alias("_ranges")).select(F.explode(F.transform(hit, lambda r: r["band"])).alias("band")).distinct()
    bands = sorted(r.band for r in touched.collect())  # MOST_BANDS numbers at most
    kind = known.schema["key"].dataType.simpleString()  # also known where there are no terms
    stored = spark.read.schema(f"term string, key {kind}, band int").parquet(f"{path}/terms")
    entries = stored.filter(F.col("band").isin(bands)).drop("band")
    return join(entries, probes, "term", "inner", salts=salts)


def _checked(df: DataFrame, key: str, text: str, open_: DataFrame, salts: int) -> DataFrame:
    """(key, term) of ``open_`` whose term stands in the row's text. A text meets all its terms at once, and most that it
    does not hold are left out by the plain substring test."""
    wanted = open_.groupBy(key).agg(F.collect_set("wanted").alias("_wanted"))
    texts = df.select(key, F.lower(F.col(text).cast("string")).alias("_subject"))
    held = join(texts, wanted, key, "inner", salts=salts).withColumn("wanted", F.explode(F.filter(
        "_wanted", lambda w: F.contains(F.col("_subject"), w)))).drop("_wanted")
    return held.filter(has("_subject", F.col("wanted"))).select(key, "wanted")


def _found(df: DataFrame, key: str, path: str, terms: DataFrame, term: str, salts: int) -> DataFrame:
    return look_up(df.sparkSession, path, _probed(terms, term), salts).select(F.col("key").alias(key), "wanted", "whole")


def _matches(df: DataFrame, key: str, text: str, path: str, terms: DataFrame, term: str, salts: int) -> DataFrame:
    """(key, term) of every row that has a term, whole words from the index alone, others after a look at the text."""
    found = _found(df, key, path, terms, term, salts)
    checked = _checked(df, key, text, found.filter(~F.col("whole")), salts)
    return found.filter("whole").select(key, "wanted").unionByName(checked)


def rows_with_any(df: DataFrame, key: str, text: str, path: str, terms: DataFrame, term: str = "term", salts: int = 0) -> DataFrame:
    """Rows whose text has at least one term of a table, as ``has_any`` finds them, by an index of the same rows.

    Empty and null terms are never found. An empty table of terms finds nothing. Only rows without one of the terms that
    are whole words are looked at for the others.
    """
    found = _found(df, key, path, terms, term, salts)
    sure = found.filter("whole").select(key).distinct()
    open_ = join(found.filter(~F.col("whole")), sure, key, "leftanti", salts=salts)
    checked = _checked(df, key, text, open_, salts).select(key)
    return join(df, sure.unionByName(checked), key, "leftsemi", salts=salts)


def rows_with_all(df: DataFrame, key: str, text: str, path: str, terms: DataFrame, term: str = "term", salts: int = 0) -> DataFrame:
    """Rows whose text has every term of a table, as ``has_all`` finds them: none if a term is empty, and all rows if
    there are no terms. Null terms are left out."""
    wanted = terms.select(F.lower(F.col(term).cast("string")).alias("wanted")).filter("wanted is not null").distinct()
    number = wanted.agg(F.count("*").alias("n")).scalar()
    found = _matches(df, key, text, path, terms, term, salts).distinct().groupBy(key).agg(F.count("*").alias("_n"))
    full = found.filter(F.col("_n") == number).select(key)
    return join(df, full, key, "leftsemi", salts=salts).unionByName(df.filter(number == 0))
