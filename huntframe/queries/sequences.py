"""Q, W: sequences of steps, row numbers, sessions and sliding windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from huntframe.functions.predicates import eq, gt
from huntframe.operators.aggregates import count, maximum, summarize
from huntframe.operators.sequences import Step, scan_steps, serialize, with_previous
from huntframe.operators.windows import mark_sessions, sliding
from huntframe.queries.registry import Tables, query, rounded


def _chain(first: str, then: str, entity: str, within: str, last: int) -> str:
    """Sequences by recursion; ``then`` and ``entity`` tell the next step's condition and who it must belong to."""
    return f"""WITH RECURSIVE chain AS (SELECT event_id, user_id, ts, ts AS started, 1 AS step FROM events WHERE {first}
        UNION SELECT e.event_id, e.user_id, e.ts, c.started, c.step + 1 FROM chain c JOIN events e
        ON {entity} AND e.ts > c.ts AND e.ts <= c.started + INTERVAL '{within}' AND ({then}) WHERE c.step < {last})
    SELECT event_id, user_id, max(started) AS started FROM chain WHERE step = {last} GROUP BY event_id, user_id"""


@query("Q1_scan_three_steps", _chain(
    "event_type = 'error'", "CASE c.step WHEN 1 THEN e.event_type = 'signup' ELSE e.event_type = 'purchase' END",
    "e.user_id = c.user_id", "2 days", 3))
def _(t: Tables):
    steps = [eq("event_type", "error"), eq("event_type", "signup"), eq("event_type", "purchase")]
    return scan_steps(t.events, ["user_id"], "ts", steps, "P2D").select("event_id", "user_id", "started")


@query("Q1_scan_same_kind", _chain("value > 60", "e.value > 60", "e.user_id = c.user_id", "1 day", 4))
def _(t: Tables):
    return scan_steps(t.events, ["user_id"], "ts", [gt("value", 60)] * 4, "P1D").select("event_id", "user_id", "started")


# The second and third event are of the user whose number is one higher than that of the step before.
@query("Q1_scan_linked_entities", _chain(
    "event_type = 'signup'", "CASE c.step WHEN 1 THEN e.event_type = 'error' ELSE e.value > 40 END",
    "e.user_id = c.user_id + 1", "6 hours", 3))
def _(t: Tables):
    user = F.col("user_id")
    steps = [Step(eq("event_type", "signup"), [user]), Step(eq("event_type", "error"), [user - 1]), Step(gt("value", 40), [user - 2])]
    return scan_steps(t.events, ["user_id"], "ts", steps, "PT6H").select("event_id", "user_id", "started")


@query("Q2_serialize", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS row_number FROM events")
def _(t: Tables):
    rows = t.events.select("event_id", "ts")
    return serialize(rows, ["ts", "event_id"], F.to_date("ts")).select("event_id", "row_number")


@query("Q2_previous_row", """SELECT event_id, lag(value) OVER w AS last_value, lag(event_type) OVER w AS last_type
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def _(t: Tables):
    out = with_previous(t.events, ["user_id"], "ts", "P1D", {"last_value": "value", "last_type": "event_type"}, ["event_id"])
    return out.select("event_id", "last_value", "last_type")


_SESSIONS = """SELECT *, max(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session_start FROM (
    SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= ts - INTERVAL '8 hours' THEN NULL ELSE ts END AS opens
    FROM events)"""


@query("W1_sessions", f"""SELECT user_id, session_start, max(ts) AS session_end, count(*) AS n, count(DISTINCT event_type) AS kinds
    FROM ({_SESSIONS}) GROUP BY user_id, session_start""")
def _(t: Tables):
    marked = mark_sessions(t.events, ["user_id"], "ts", "PT8H")
    return marked.groupBy("user_id", "session_start").agg(
        F.max("ts").alias("session_end"), F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("kinds"))


@query("W1_longest_sessions", f"""SELECT event_type, max(n) AS longest FROM (SELECT user_id, session_start, event_type, count(*) AS n
    FROM ({_SESSIONS}) GROUP BY user_id, session_start, event_type) GROUP BY event_type""")
def _(t: Tables):
    marked = mark_sessions(t.events, ["user_id"], "ts", "PT8H", every="P1D")
    per_session = summarize(marked, ["user_id", "session_start", "event_type"], n=count())
    return summarize(per_session, ["event_type"], longest=maximum("n"))


@query("W2_sliding", """SELECT event_type, w AS ts, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total,
    min(value) AS low, max(value) AS high, round(avg(value), 9) AS mean FROM (SELECT *, unnest(generate_series(
        time_bucket(INTERVAL '1 hour', ts) - INTERVAL '5 hours', time_bucket(INTERVAL '1 hour', ts), INTERVAL '1 hour')) AS w
    FROM events) GROUP BY event_type, w""")
def _(t: Tables):
    out = sliding(t.events, ["event_type"], "ts", "PT1H", "PT6H", n="count", users=("dcount", "user_id"), total=("sum", "value"),
                  low=("min", "value"), high=("max", "value"), mean=("avg", "value"))
    return rounded(rounded(out, 2, "total"), 9, "mean")
