"""P: the detections."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from huntframe.functions import predicates as P
from huntframe.operators.aggregates import count
from huntframe.operators.stages import ANY, Capture
from huntframe.plans import detections as D
from huntframe.queries.registry import AS_OF, MONTH_START, Tables, address, joined, query, rounded

_DAY = "time_bucket(INTERVAL '1 day', ts)"


@query("P01_threshold_per_entity", f"""SELECT user_id, {_DAY} AS ts, count(*) AS n FROM events
    WHERE event_type = 'error' GROUP BY ALL HAVING count(*) > 1""")
def flagship(t: Tables):
    errors = t.events.filter(P.eq("event_type", "error"))
    return D.threshold_per_entity(errors, ["user_id"], "P1D", 1, "ts")


@query("P01_distinct_threshold", f"""SELECT user_id, {_DAY} AS ts, count(DISTINCT event_type) AS n FROM events
    GROUP BY ALL HAVING count(DISTINCT event_type) > 2""")
def _(t: Tables):
    return D.threshold_per_entity(t.events, ["user_id"], "P1D", 2, "ts", distinct="event_type")


@query("P02_baseline_vs_current", """SELECT user_id, CurrentCount, BaselineCount, round(BaselineCount / 14.0, 6) AS BaselineAvg,
    round(CurrentCount - BaselineCount / 14.0, 6) AS Margin FROM (
    SELECT user_id, count(*) FILTER (ts >= TIMESTAMP '2024-01-29') AS CurrentCount, count(*) AS BaselineCount
    FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND ts < TIMESTAMP '2024-01-30' GROUP BY user_id)
    WHERE CurrentCount > 0 AND CurrentCount - BaselineCount / 14.0 > 1""")
def _(t: Tables):
    out = D.baseline_vs_current(t.events, ["user_id"], datetime(2024, 1, 30), 1.0, "ts")
    return rounded(out, 6, "BaselineAvg", "Margin")


@query("P03_ordered_pair", """SELECT user_id, f AS FirstTime, s AS ThenTime, round(epoch_us(s - f) / 60e6, 6) AS "Between"
    FROM (SELECT user_id, min(ts) FILTER (event_type = 'signup') AS f, min(ts) FILTER (event_type = 'purchase') AS s
    FROM events GROUP BY user_id) WHERE s > f AND epoch_us(s - f) / 60e6 <= 1440""")
def _(t: Tables):
    out = D.ordered_pair(t.events, ["user_id"], P.eq("event_type", "signup"), P.eq("event_type", "purchase"),
                         "minute", 1440, "ts")
    return rounded(out, 6, "Between")


@query("P04_rare_entities", """SELECT l_partkey, Frequency, "Limit" FROM (
    SELECT l_partkey, count(*) AS Frequency FROM lineitem GROUP BY l_partkey) f,
    (SELECT quantile_cont(c, 0.05) AS "Limit" FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_partkey))
    WHERE Frequency <= "Limit" """)
def _(t: Tables):
    return D.rare_entities(t.lineitem, ["l_partkey"], 5)


@query("P05_inside_activity_span", """SELECT e.event_id, e.user_id, s.FirstSeen, s.LastSeen FROM events e JOIN (
    SELECT user_id, min(ts) AS FirstSeen, max(ts) AS LastSeen FROM events WHERE event_type = 'click' GROUP BY user_id) s
    ON s.user_id = e.user_id AND e.ts BETWEEN s.FirstSeen AND s.LastSeen
    WHERE e.event_type = 'purchase' AND e.value > 20""")
def _(t: Tables):
    bought = t.events.filter(P.all_of(P.eq("event_type", "purchase"), P.gt("value", 20))).select(
        "event_id", "user_id", "ts")
    clicks = t.events.filter(P.eq("event_type", "click"))
    out = D.inside_activity_span(bought, clicks, ["user_id"], "ts")
    return out.select("event_id", "user_id", "FirstSeen", "LastSeen")


@query("P06_regularity", f"""SELECT user_id, round(sd, 6) AS Deviation, round(m, 6) AS Average, b AS Bins,
    round(sd / m, 6) AS Variation FROM (SELECT user_id, stddev_samp(n) AS sd, avg(n) AS m, count(*) AS b FROM (
    SELECT user_id, {_DAY}, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id) WHERE sd / m < 0.55""")
def _(t: Tables):
    out = D.regularity(t.events, ["user_id"], "P1D", 0.55, "ts")
    return rounded(out, 6, "Deviation", "Average", "Variation")


_REST = "OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW)"


@query("P07_outlier_buckets", f"""SELECT user_id, ts, n AS "Value", CASE WHEN z > 3 THEN 1 ELSE -1 END AS AnomalyFlag,
    round(z, 6) AS AnomalyScore, round(m, 6) AS Baseline FROM (
    SELECT user_id, ts, n, m, (n - m) / CASE WHEN sd > 0 THEN sd ELSE 1e-9 END AS z FROM (
    SELECT user_id, ts, n, avg(n) {_REST} AS m, stddev_pop(n) {_REST} AS sd FROM (
        SELECT u.user_id, d.b AS ts, count(e.event_id) AS n FROM (SELECT DISTINCT user_id FROM events) u
        CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL '1 day')) AS b) d
        LEFT JOIN events e ON e.user_id = u.user_id AND e.ts >= d.b AND e.ts < d.b + INTERVAL '1 day'
        GROUP BY ALL))) WHERE abs(z) > 3""")
def _(t: Tables):
    out = D.outlier_buckets(t.events, ["user_id"], MONTH_START, AS_OF, "P1D", count(), 3.0, "ts")
    return rounded(out, 6, "AnomalyScore", "Baseline")


@query("P08_latest_row", """SELECT event_id, user_id, ts, event_type, value, props FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn = 1""")
def _(t: Tables):
    return D.latest_row(t.events, ["user_id"], "ts", "event_id")


@query("P08_first_row_per_day", f"""SELECT event_id, user_id, ts, event_type, value, props FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, {_DAY} ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def _(t: Tables):
    return D.first_row(t.events, ["user_id"], "ts", "event_id", every="P1D")


@query("P09_active_indicators", """SELECT o.o_orderkey, o.k, i.event_type FROM (
    SELECT o_orderkey, o_custkey AS k FROM orders WHERE o_totalprice > 100000) o JOIN (
    SELECT user_id AS k, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn
        FROM events) WHERE rn = 1 AND event_type <> 'error') i ON o.k = i.k""")
def _(t: Tables):
    orders = t.orders.filter("o_totalprice > 100000").select("o_orderkey", F.col("o_custkey").alias("k"))
    versions = t.events.select(F.col("user_id").alias("k"), "ts", "event_id", "event_type")
    out = D.active_indicators_seen(versions, orders, "k", P.ne("event_type", "error"), "k", "ts", "event_id")
    return out.select("o_orderkey", "k", "event_type")


def _word(w: str, options: str = "i") -> str:
    return f"regexp_matches(text, '(^|[^A-Za-z0-9_]){w}($|[^A-Za-z0-9_])', '{options}')"


@query("P10_renamed_tool", f"""SELECT doc_id, source FROM documents WHERE {_word('the')} AND {_word('of')} AND {_word('with')}
    AND NOT suffix(lower(source), '1')""")
def _(t: Tables):
    return D.renamed_tool(t.documents, "text", ["the", "of", "with"], "source", "1").select("doc_id", "source")


@query("P11_category_mismatch", """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE
    (o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT') OR (o_orderstatus = 'O' AND o_orderpriority <> '2-HIGH')
    OR (o_orderstatus = 'P' AND o_orderpriority <> '3-MEDIUM')""")
def _(t: Tables):
    out = D.category_mismatch(t.orders, "o_orderstatus", "o_orderpriority",
                              {"F": "1-URGENT", "O": "2-HIGH", "P": "3-MEDIUM"})
    return out.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("P12_first_seen", """SELECT user_id, props, min(ts) AS FirstSeen, max(ts) AS LastSeen FROM events r
    WHERE ts >= TIMESTAMP '2024-01-28' AND NOT EXISTS (SELECT 1 FROM events h WHERE h.user_id = r.user_id
        AND h.props = r.props AND h.ts >= TIMESTAMP '2024-01-14' AND h.ts < TIMESTAMP '2024-01-28')
    GROUP BY user_id, props""")
def _(t: Tables):
    return D.first_seen(t.events, ["user_id", "props"], datetime(2024, 1, 28), datetime(2024, 1, 14), "ts")


@query("P13_extract_and_count", """SELECT regexp_extract(props, '^.*?: (.*?)\\}$', 1) AS K, count(*) AS n FROM events
    GROUP BY 1 HAVING count(*) > 95""")
def _(t: Tables):
    return D.extract_and_count(t.events, "props", (ANY, ": ", Capture("K"), "}"), "K", 95)


@query("P14_touched_items", """SELECT DISTINCT l_suppkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE suffix(lower(p_name), 'bolt')""")
def _(t: Tables):
    lines = t.lineitem.select("l_suppkey", F.col("l_partkey").alias("p_partkey"))
    named = lines.join(t.part.select("p_partkey", "p_name"), "p_partkey")
    return D.touched_items(named, ["l_suppkey"], "p_name", P.endswith("p_name", "BOLT"))


@query("P15_external_to_ports", f"""SELECT c_custkey, ip, c_nationkey FROM (SELECT *, {address()} AS ip FROM customer)
    WHERE NOT (starts_with(ip, '10.') OR starts_with(ip, '192.168.') OR
        (starts_with(ip, '172.') AND CAST(split_part(ip, '.', 2) AS INT) BETWEEN 16 AND 31)) AND c_nationkey IN (3, 5, 7)""")
def _(t: Tables):
    seen = t.customer.selectExpr("c_custkey", "c_nationkey", f"{address()} AS ip")
    return D.external_to_ports(seen, "ip", "c_nationkey", [3, 5, 7]).select("c_custkey", "ip", "c_nationkey")


@query("P16_noisiest", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def _(t: Tables):
    return D.noisiest(t.events, ["user_id"], 10)


@query("P17_inventory", """SELECT user_id, event_type, count(*) AS n, min(ts) AS FirstSeen, max(ts) AS LastSeen
    FROM events GROUP BY ALL""")
def _(t: Tables):
    return D.inventory(t.events, ["user_id", "event_type"], "ts")


@query("P18_threshold_with_evidence", """SELECT g.user_id, n, FirstSeen, LastSeen, Evidence FROM (
    SELECT user_id, count(*) AS n, min(ts) AS FirstSeen, max(ts) AS LastSeen FROM events GROUP BY user_id) g JOIN (
    SELECT user_id, string_agg(props, ',' ORDER BY f) AS Evidence FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f) AS rn FROM (
            SELECT user_id, props, min((ts, event_id)) AS f FROM events GROUP BY ALL)) WHERE rn <= 5 GROUP BY user_id) e
    ON g.user_id = e.user_id WHERE n > 70""")
def _(t: Tables):
    out = D.threshold_with_evidence(t.events, ["user_id"], 70, "props", 5, ("ts", "event_id"))
    return joined(out, "Evidence")


@query("P19_two_term_sets", f"""SELECT doc_id FROM documents WHERE ({_word('which')} OR {_word('from')})
    AND ({_word('the')} OR {_word('is')})""")
def _(t: Tables):
    return D.two_term_sets(t.documents, "text", ["which", "from"], ["the", "is"]).select("doc_id")


@query("P20_fragment_and_flag", f"""SELECT doc_id FROM documents WHERE {_word('for')} AND contains(text, 'Th')""")
def _(t: Tables):
    return D.fragment_and_flag(t.documents, "text", "Th", "FOR").select("doc_id")


@query("P21_many_values", """SELECT c.user_id, c.d AS "Distinct", v.s AS "Values" FROM (
    SELECT user_id, count(DISTINCT props) AS d FROM events GROUP BY user_id) c JOIN (
    SELECT user_id, string_agg(props, ',' ORDER BY f) AS s FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f) AS rn FROM (
            SELECT user_id, props, min((ts, event_id)) AS f FROM events GROUP BY ALL)) WHERE rn <= 8 GROUP BY user_id) v
    ON c.user_id = v.user_id WHERE c.d >= 52""")
def _(t: Tables):
    return joined(D.many_values(t.events, ["user_id"], "props", 52, 8, ("ts", "event_id")), "Values")


@query("P22_fires_per_rule", """SELECT event_type, count(*) FILTER (value > 340) > 0 AS fired FROM events GROUP BY event_type""")
def _(t: Tables):
    peak = t.events.groupBy("event_type").agg(F.max("value").alias("peak"))
    return peak.select("event_type", P.gt("peak", 340).alias("fired"))
