"""Streaming forms of detections, run over all events there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntframe.functions.predicates import eq
from huntframe.queries.registry import Tables, query
from huntframe.session import scratch_path
from huntframe.sources.writers import append_stream
from huntframe.streaming.pairs import first_seen_stream, followed_stream


def _events(t: Tables) -> DataFrame:
    """The events as a stream, in a session of its own: its state has as many partitions as there are cores."""
    session = t.spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.shuffle.partitions", str(session.sparkContext.defaultParallelism))
    # as a pattern, since a stream's folder may not be a single file
    rows = session.readStream.schema(t.events.schema).parquet(f"{t.folder}/event[s].parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _all_of(t: Tables, stream: DataFrame) -> DataFrame:
    path = scratch_path(t.spark, "stream")
    append_stream(stream, f"{path}/rows", f"{path}/state")
    return t.spark.read.schema(stream.schema).parquet(f"{path}/rows")


@query("P03_ordered_pair_stream", """SELECT event_id, user_id, ts FROM events t WHERE event_type = 'purchase' AND EXISTS (
    SELECT 1 FROM events f WHERE f.user_id = t.user_id AND f.event_type = 'signup' AND f.ts < t.ts AND f.ts >= t.ts - INTERVAL '12 hours')""")
def _(t: Tables):
    # The events may be read in any order, so none of the month is late.
    out = followed_stream(_events(t), ["user_id"], eq("event_type", "signup"), eq("event_type", "purchase"), "PT12H", "ts", "P60D", "event_id", 4)
    return _all_of(t, out.select("event_id", "user_id", "ts")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# Bins that end at least an hour before the last event are closed.
@query("P12_first_seen_stream", """WITH b AS (SELECT date_trunc('day', ts) AS d, user_id, event_type, min(ts) AS FirstSeen, max(ts) AS LastSeen,
        count(*) AS n FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL)
    SELECT d AS ts, user_id, event_type, FirstSeen, LastSeen, n FROM b WHERE d + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)
    AND NOT EXISTS (SELECT 1 FROM b o WHERE o.user_id = b.user_id AND o.event_type = b.event_type AND o.d < b.d AND o.d >= b.d - INTERVAL '5 days')""")
def _(t: Tables):
    out = _all_of(t, first_seen_stream(_events(t), ["user_id", "event_type"], "P1D", "P5D", "ts", "PT1H"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "FirstSeen", "LastSeen")})
