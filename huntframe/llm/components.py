"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntframe.session import scratch_path, store


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    store(df, path)
    return df.sparkSession.read.parquet(path)


def connected(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links (a, b) reach from each id that has a link.

    Large-star and small-star steps in turn (Kiveris et al., 2014), each round stored in the shared folder,
    until nothing changes; the number of rounds grows with the logarithm of the number of links.
    """
    def towards_smallest(edges: DataFrame, larger: bool) -> DataFrame:
        # large-star looks at all neighbours of a vertex and moves the larger ones, small-star at the smaller ones
        seen = edges.union(edges.select("b", "a")).toDF("a", "b") if larger else edges
        least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        moved = seen.join(least, "a")
        if larger:
            moved = moved.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        else:
            moved = moved.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
                least.select("a", F.col("least").alias("b")))
        return moved.filter("a != b").distinct()

    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    edges, before = _stored(edges, "links"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        edges = _stored(towards_smallest(towards_smallest(edges, True), False), "links")
    own = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(own)
