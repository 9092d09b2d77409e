"""J: the join kinds and joins with a time condition."""

from __future__ import annotations

from pyspark.sql import functions as F

from huntframe.functions.predicates import eq
from huntframe.operators.aggregates import maximum, minimum, percentile, summarize
from huntframe.operators.joins import attach, followed_by, join, within_span
from huntframe.queries.registry import Tables, query, rounded

# Rich customers on the left, large orders on the right: each side has rows without a partner.
_LEFT = "(SELECT c_custkey AS k, c_name AS name, c_acctbal AS amount FROM customer WHERE c_acctbal > 2000)"
_RIGHT = "(SELECT o_custkey AS k, o_orderkey, o_totalprice AS amount FROM orders WHERE o_totalprice > 250000)"


def _left(t: Tables):
    return t.customer.filter("c_acctbal > 2000").select(
        F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"))


def _right(t: Tables):
    return t.orders.filter("o_totalprice > 250000").select(
        F.col("o_custkey").alias("k"), "o_orderkey", F.col("o_totalprice").alias("amount"))


_COLUMNS = "k, l.name, l.amount, r.o_orderkey, r.amount AS amount_right"

_KINDS = {
    "J01_inner": ("inner", f"SELECT {_COLUMNS} FROM {_LEFT} l JOIN {_RIGHT} r USING (k)"),
    "J03_leftouter": ("leftouter", f"SELECT {_COLUMNS} FROM {_LEFT} l LEFT JOIN {_RIGHT} r USING (k)"),
    "J04_rightouter": ("rightouter", f"SELECT {_COLUMNS} FROM {_LEFT} l RIGHT JOIN {_RIGHT} r USING (k)"),
    "J05_fullouter": ("fullouter", f"SELECT {_COLUMNS} FROM {_LEFT} l FULL JOIN {_RIGHT} r USING (k)"),
    "J06_leftanti": ("leftanti", f"SELECT * FROM {_LEFT} WHERE k NOT IN (SELECT k FROM {_RIGHT})"),
    "J07_leftsemi": ("leftsemi", f"SELECT * FROM {_LEFT} WHERE k IN (SELECT k FROM {_RIGHT})"),
    "J08_rightanti": ("rightanti", f"SELECT * FROM {_RIGHT} WHERE k NOT IN (SELECT k FROM {_LEFT})"),
    "J09_rightsemi": ("rightsemi", f"SELECT * FROM {_RIGHT} WHERE k IN (SELECT k FROM {_LEFT})"),
}


def _register(name, kind, sql):
    @query(name, sql)
    def build(t: Tables):
        return join(_left(t), _right(t), "k", kind)

    @query(f"{name}_salted", sql)
    def build_salted(t: Tables):
        return join(_left(t), _right(t), "k", kind, salts=16)


for _name, (_kind, _sql) in _KINDS.items():
    _register(_name, _kind, _sql)


@query("J02_innerunique", """SELECT l_orderkey AS k, l_linenumber, l_partkey, o_totalprice FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) l
    JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE rn = 1""")
def _(t: Tables):
    lines = t.lineitem.select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey")
    orders = t.orders.select(F.col("o_orderkey").alias("k"), "o_totalprice")
    return join(lines, orders, "k", "innerunique", first=["l_linenumber", "l_partkey", "l_suppkey"]).drop("l_suppkey")


_NULLABLE = "(SELECT doc_id, CASE WHEN lang <> 'fr' THEN source END AS tag FROM documents)"


@query("J01_null_safe", f"""SELECT l.doc_id, r.n FROM {_NULLABLE} l JOIN
    (SELECT tag, count(*) AS n FROM {_NULLABLE} GROUP BY tag) r ON l.tag IS NOT DISTINCT FROM r.tag""")
def _(t: Tables):
    docs = t.documents.select("doc_id", F.when(F.col("lang") != "fr", F.col("source")).alias("tag"))
    sizes = docs.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return join(docs, sizes, "tag", "inner", null_safe=True).select("doc_id", "n")


@query("J10_right_side_with_stages", """SELECT e.event_id, e.user_id, r.purchases FROM events e JOIN (
    SELECT user_id, count(*) AS purchases FROM events WHERE event_type = 'purchase' GROUP BY user_id HAVING count(*) > 12) r
    ON e.user_id = r.user_id WHERE e.event_type = 'error'""")
def _(t: Tables):
    buyers = (t.events.filter(eq("event_type", "purchase")).groupBy("user_id")
              .agg(F.count(F.lit(1)).alias("purchases")).filter("purchases > 12"))
    errors = t.events.filter(eq("event_type", "error")).select("event_id", "user_id")
    return join(errors, buyers, "user_id", "inner", salts=16)


@query("J11_global_statistic", """SELECT event_id, value, round(p99, 4) AS p99 FROM events,
    (SELECT quantile_cont(value, 0.99) AS p99 FROM events) WHERE value > p99""")
def _(t: Tables):
    limit = summarize(t.events, p99=percentile("value", 99))
    out = attach(t.events.select("event_id", "value"), limit, p99="p99").filter("value > p99")
    return rounded(out, 4, "p99")


@query("J12_interval", """SELECT e.event_id, e.user_id FROM events e JOIN (
    SELECT user_id, min(ts) AS a, max(ts) AS b FROM events WHERE event_type = 'signup' GROUP BY user_id) s
    ON e.user_id = s.user_id AND e.ts >= s.a AND e.ts <= s.b WHERE e.event_type = 'error'""")
def _(t: Tables):
    signups = t.events.filter(eq("event_type", "signup"))
    spans = summarize(signups, ["user_id"], a=minimum("ts"), b=maximum("ts"))
    errors = t.events.filter(eq("event_type", "error")).select("event_id", "user_id", "ts")
    return within_span(errors, spans, ["user_id"], "ts", "a", "b", salts=16).select("event_id", "user_id")


@query("J13_ordered_within_window", """SELECT b.event_id, b.user_id, count(*) AS earlier, max(a.ts) AS latest_first
    FROM events b JOIN events a ON a.user_id = b.user_id AND a.event_type = 'error'
        AND a.ts < b.ts AND a.ts >= b.ts - INTERVAL '6 hours'
    WHERE b.event_type = 'purchase' GROUP BY b.event_id, b.user_id""")
def _(t: Tables):
    out = followed_by(t.events, ["user_id"], "ts", eq("event_type", "error"), eq("event_type", "purchase"), "PT6H")
    return out.select("event_id", "user_id", "earlier", "latest_first")


@query("J14_not_in_subquery", """SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (
    SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def _(t: Tables):
    urgent = t.orders.filter(eq("o_orderpriority", "1-URGENT")).select(F.col("o_custkey").alias("c_custkey"))
    return join(t.customer.select("c_custkey", "c_name"), urgent, "c_custkey", "leftanti")


@query("J14_in_subquery", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (
    SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def _(t: Tables):
    machinery = t.customer.filter(eq("c_mktsegment", "MACHINERY")).select(F.col("c_custkey").alias("o_custkey"))
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return join(orders, machinery, "o_custkey", "leftsemi", salts=16).select("o_orderkey", "o_totalprice")
