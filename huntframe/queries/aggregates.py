"""A and T: summaries and series."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from huntframe.operators.aggregates import (
    arg_max, arg_min, avg, count, dcount, distinct_items, listed_items, make_list, make_set, maximum, minimum, percentile,
    stdev, summarize, total, variance,
)
from huntframe.operators.series import expand_series, make_series, series_anomaly
from huntframe.operators.stages import union
from huntframe.queries.registry import AS_OF, MONTH_START, Tables, joined, query, rounded


@query("A00_A02_count_by_key", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def _(t: Tables):
    return summarize(t.events, ["event_type", "user_id"], n=count("props"))


@query("A00_null_key_group", """SELECT tag, count(*) AS n FROM (
    SELECT CASE WHEN lang <> 'fr' THEN source END AS tag FROM documents) GROUP BY tag""")
def _(t: Tables):
    tag = F.when(F.col("lang") != "fr", F.col("source"))
    return summarize(t.documents.select(tag.alias("tag")), ["tag"], n=count())


@query("A01_time_bin", """SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS ts, count(*) AS n
    FROM events GROUP BY ALL""")
def _(t: Tables):
    return summarize(t.events, ["user_id"], every="PT1H", time="ts", n=count())


@query("A01_time_bin_with_origin", """SELECT time_bucket(INTERVAL '14 days', ts, TIMESTAMP '2024-01-31') AS ts, count(*) AS n
    FROM events GROUP BY ALL""")
def _(t: Tables):
    return summarize(t.events, every="P14D", time="ts", origin=AS_OF, n=count())


@query("A03_dcount", """SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT props) AS kinds
    FROM events GROUP BY event_type""")
def _(t: Tables):
    return summarize(t.events, ["event_type"], users=dcount("user_id"), kinds=dcount("props"))


@query("A03_dcount_approx")
def _(t: Tables):
    return summarize(t.events, ["event_type"], users=dcount("user_id", approx=True))


@query("A04_A05_sum_avg", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty,
    round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY ALL""")
def _(t: Tables):
    out = summarize(t.lineitem, ["l_returnflag", "l_linestatus"], qty=total("l_quantity"),
                    price=avg("l_extendedprice"))
    return rounded(rounded(out, 2, "qty"), 4, "price")


@query("A04_sum_of_text", """SELECT event_type, coalesce(sum(try_cast(k AS double)), 0) AS s FROM (
    SELECT event_type, CASE WHEN event_type <> 'view' THEN regexp_extract(props, '([0-9]+)', 1) ELSE 'none' END AS k
    FROM events) GROUP BY event_type""")
def _(t: Tables):
    k = F.when(F.col("event_type") != "view", F.regexp_extract("props", "([0-9]+)", 1)).otherwise("none")
    return summarize(t.events.select("event_type", k.alias("k")), ["event_type"], s=total("k"))


@query("A06_A07_min_max", """SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, max(event_type) AS last_kind
    FROM events GROUP BY user_id""")
def _(t: Tables):
    return summarize(t.events, ["user_id"], first_ts=minimum("ts"), last_ts=maximum("ts"),
                     last_kind=maximum("event_type"))


@query("A08_percentile", """SELECT event_type, round(quantile_cont(value, 0.95), 4) AS p95,
    round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.0), 4) AS p0 FROM events GROUP BY event_type""")
def _(t: Tables):
    out = summarize(t.events, ["event_type"], p95=percentile("value", 95), p50=percentile("value", 50),
                    p0=percentile("value", 0))
    return rounded(out, 4, "p95", "p50", "p0")


@query("A08_percentile_overall", """SELECT round(quantile_cont(l_extendedprice, 0.9), 4) AS p90,
    count(*) AS n FROM lineitem""")
def _(t: Tables):
    return rounded(summarize(t.lineitem, p90=percentile("l_extendedprice", 90), n=count()), 4, "p90")


@query("A08_percentile_approx")
def _(t: Tables):
    return summarize(t.events, ["event_type"], p95=percentile("value", 95, approx=True))


@query("A09_make_set", """SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS kinds FROM (
    SELECT user_id, event_type, min((ts, event_id)) AS f FROM events GROUP BY ALL) GROUP BY user_id""")
def _(t: Tables):
    out = summarize(t.events, ["user_id"], kinds=make_set("event_type", order=("ts", "event_id")))
    return joined(out, "kinds")


@query("A09_make_set_limit", """SELECT event_type, string_agg(user_id, ',' ORDER BY f) AS users FROM (
    SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY f) AS rn FROM (
        SELECT event_type, user_id, min((ts, event_id)) AS f FROM events GROUP BY ALL))
    WHERE rn <= 10 GROUP BY event_type""")
def _(t: Tables):
    out = summarize(t.events, ["event_type"], users=make_set("user_id", 10, ("ts", "event_id")))
    return joined(out, "users")


@query("A09_set_as_rows", "SELECT DISTINCT user_id, props FROM events")
def _(t: Tables):
    return distinct_items(t.events, ["user_id"], "props")


@query("A10_list_as_rows", """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position, event_id
    FROM events""")
def _(t: Tables):
    return listed_items(t.events, ["user_id"], "event_id", ["ts", "event_id"], "ts", "P1D")


@query("A10_make_list", """SELECT event_type, string_agg(event_id, ',' ORDER BY ts, event_id) AS ids FROM (
    SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events)
    WHERE rn <= 5 GROUP BY event_type""")
def _(t: Tables):
    out = summarize(t.events, ["event_type"], ids=make_list("event_id", 5, ("ts", "event_id")))
    return joined(out, "ids")


@query("A11_A12_stdev_variance", """SELECT user_id, round(stddev_samp(value), 6) AS sd, round(var_samp(value), 4) AS var
    FROM events GROUP BY user_id""")
def _(t: Tables):
    out = summarize(t.events, ["user_id"], sd=stdev("value"), var=variance("value"))
    return rounded(rounded(out, 6, "sd"), 4, "var")


@query("A13_arg_max_all", """SELECT user_id, value, event_id, ts, event_type, props FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn = 1""")
def _(t: Tables):
    return summarize(t.events, ["user_id"], picks=(arg_max("value", "*", first="event_id"),))


@query("A13_arg_max_alias", """SELECT event_type, value AS Peak, user_id FROM (
    SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn = 1""")
def _(t: Tables):
    return summarize(t.events, ["event_type"],
                     picks=(arg_max("value", "user_id", alias="Peak", first="event_id"),))


@query("A14_arg_min", """SELECT user_id, ts, event_type, value FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def _(t: Tables):
    return summarize(t.events, ["user_id"], picks=(arg_min("ts", "event_type", "value", first="event_id"),))


@query("A15_plain_and_arg", """SELECT user_id, n, round(s, 2) AS s, ts, event_type FROM (
    SELECT user_id, ts, event_type, count(*) OVER (PARTITION BY user_id) AS n, sum(value) OVER (PARTITION BY user_id) AS s,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn = 1""")
def _(t: Tables):
    out = summarize(t.events, ["user_id"], n=count(), s=total("value"),
                    picks=(arg_max("ts", "event_type", first="event_id"),))
    return rounded(out, 2, "s")


@query("A16_global", """SELECT count(*) AS n, round(avg(value), 6) AS mean, max(ts) AS last FROM events HAVING count(*) > 0""")
def _(t: Tables):
    return rounded(summarize(t.events, n=count(), mean=avg("value"), last=maximum("ts")), 6, "mean")


@query("A16_global_of_nothing_has_no_row", """SELECT 'some' AS part, count(*) AS n FROM events WHERE value > 300 HAVING count(*) > 0
    UNION ALL SELECT 'none', count(*) FROM events WHERE value < 0 HAVING count(*) > 0""")
def _(t: Tables):
    some, none = (summarize(t.events.filter(test), n=count()).select(F.lit(part).alias("part"), "n")
                  for part, test in (("some", "value > 300"), ("none", "value < 0")))
    return union(some, none)


@query("A17_distinct_keys", "SELECT DISTINCT user_id, event_type FROM events")
def _(t: Tables):
    return summarize(t.events, ["user_id", "event_type"])


@query("A18_conditional_counts", """SELECT user_id, count(*) FILTER (event_type = 'error') AS errors,
    count(DISTINCT CASE WHEN value > 50 THEN event_type END) AS big_kinds FROM events GROUP BY user_id""")
def _(t: Tables):
    return t.events.groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.count_distinct(F.when(F.col("value") > 50, F.col("event_type"))).alias("big_kinds"))


@query("A19_population_spread", """SELECT event_type, round(stddev_pop(value), 6) AS sd, round(var_pop(value), 4) AS var
    FROM events GROUP BY event_type""")
def _(t: Tables):
    return t.events.groupBy("event_type").agg(
        F.round(F.stddev_pop("value"), 6).alias("sd"), F.round(F.var_pop("value"), 4).alias("var"))


# --- series ------------------------------------------------------------------------------------

_DAYS = """(SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL '1 day')) AS b)"""

# Errors only in part of the month: some users have no row in range and keep an all-zero series.
_SERIES = f"""(SELECT u.user_id, d.b AS ts, count(e.event_id) AS n, coalesce(max(e.value), 0) AS peak
    FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN {_DAYS} d
    LEFT JOIN events e ON e.user_id = u.user_id AND e.ts >= d.b AND e.ts < d.b + INTERVAL '1 day'
    GROUP BY ALL)"""


def _daily(t: Tables):
    return make_series(t.events, MONTH_START, AS_OF, "P1D", ["user_id"], "ts", n=count(), peak=maximum("value"))


@query("T1_make_series", f"""SELECT user_id, string_agg(n, ',' ORDER BY ts) AS n, count(*) AS buckets
    FROM {_SERIES} GROUP BY user_id""")
def _(t: Tables):
    out = _daily(t)
    return joined(out.select("user_id", "n", F.size("ts").cast("long").alias("buckets")), "n")


@query("T1_make_series_keeps_absent_keys", """SELECT user_id, string_agg(n, ',' ORDER BY b) AS n FROM (
    SELECT u.user_id, d.b, count(e.event_id) AS n FROM (SELECT DISTINCT user_id FROM events) u
    CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-03 11:00:00', INTERVAL '1 hour')) AS b) d
    LEFT JOIN events e ON e.user_id = u.user_id AND e.ts >= d.b AND e.ts < d.b + INTERVAL '1 hour'
    GROUP BY ALL) GROUP BY user_id""")
def _(t: Tables):
    out = make_series(t.events, datetime(2024, 1, 3), datetime(2024, 1, 3, 12), "PT1H", ["user_id"], "ts",
                      n=count())
    return joined(out.drop("ts"), "n")


@query("T1_make_series_no_keys", f"""SELECT string_agg(n, ',' ORDER BY ts) AS n FROM (
    SELECT ts, CAST(sum(n) AS BIGINT) AS n FROM {_SERIES} GROUP BY ts)""")
def _(t: Tables):
    return joined(make_series(t.events, MONTH_START, AS_OF, "P1D", (), "ts", n=count()).drop("ts"), "n")


_REST = "OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW)"
ANOMALY_SQL = f"""SELECT user_id, ts, n, CASE WHEN z > 1.5 THEN 1 WHEN z < -1.5 THEN -1 ELSE 0 END AS flag,
    round(z, 6) AS score, round(m, 6) AS baseline FROM (
    SELECT user_id, ts, n, m, (n - m) / CASE WHEN sd > 0 THEN sd ELSE 1e-9 END AS z FROM (
    SELECT user_id, ts, n, avg(n) {_REST} AS m, stddev_pop(n) {_REST} AS sd FROM {_SERIES}))"""


def _scored(t: Tables):
    scored = series_anomaly(_daily(t), "n", 1.5, "flag", "score", "baseline")
    rows = expand_series(scored.drop("peak"), "ts", "n", "flag", "score", "baseline")
    return rounded(rows, 6, "score", "baseline")


@query("T2_T3_series_anomaly", ANOMALY_SQL)
def _(t: Tables):
    return _scored(t)


@query("T4_series_line", """SELECT user_id, round(regr_slope(n, i), 6) AS slope, round(regr_intercept(n, i), 6) AS intercept
    FROM (SELECT user_id, n, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i FROM """ + _SERIES + """)
    GROUP BY user_id""")
def _(t: Tables):
    points = _daily(t).select("user_id", F.posexplode("n").alias("i", "n"))
    return points.groupBy("user_id").agg(F.round(F.regr_slope("n", "i"), 6).alias("slope"),
                                         F.round(F.regr_intercept("n", "i"), 6).alias("intercept"))
