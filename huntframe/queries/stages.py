"""X, L and the scans and sinks."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from huntframe.functions.predicates import any_of, eq
from huntframe.functions.scalars import divide
from huntframe.operators.stages import (
    Capture, extend, flatten_struct, mv_expand, parse, project, top, union, union_tables,
)
from huntframe.queries.registry import AS_OF, Tables, query, rounded
from huntframe.session import scratch_path
from huntframe.sources.readers import (
    scan, scan_events, scan_field_rows, scan_json_documents, scan_jsonl, scan_whole_texts,
)
from huntframe.sources.writers import append_results, write_events, write_jsonl, write_routed


@query("X01_project", "SELECT event_id, event_type FROM events")
def _(t: Tables):
    return project(t.events, "event_id", "event_type")


@query("X02_extend", """SELECT event_id, round(value * 2, 4) AS doubled, round(value * 2 + 1, 4) AS plus_one,
    concat(event_type, '!') AS event_type FROM events""")
def _(t: Tables):
    out = extend(t.events, doubled=F.col("value") * 2, plus_one=F.col("doubled") + 1,
                 event_type=F.concat("event_type", F.lit("!")))
    return rounded(out.select("event_id", "doubled", "plus_one", "event_type"), 4, "doubled", "plus_one")


@query("X03_arithmetic", """SELECT l_orderkey, l_linenumber, l_partkey,
    CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_discount END AS ratio,
    -l_extendedprice * (1 - l_discount) + l_tax AS net FROM lineitem""")
def _(t: Tables):
    out = extend(t.lineitem, ratio=divide("l_extendedprice", "l_discount"),
                 net=-F.col("l_extendedprice") * (1 - F.col("l_discount")) + F.col("l_tax"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "ratio", "net")


@query("X04_logic", """SELECT event_id, (value > 50 AND event_type = 'error') OR NOT (user_id <= 100) AS odd,
    value <> 10 AS differs FROM events""")
def _(t: Tables):
    value = F.col("value")
    out = extend(t.events, odd=((value > 50) & (F.col("event_type") == "error")) | ~(F.col("user_id") <= 100),
                 differs=value != 10)
    return out.select("event_id", "odd", "differs")


@query("X06_parse", """SELECT page_id,
    CASE WHEN fits THEN regexp_extract(url, p, 1) END AS Scheme,
    CASE WHEN fits THEN regexp_extract(url, p, 2) END AS Host,
    CASE WHEN fits THEN regexp_extract(url, p, 3) END AS Rest
    FROM (SELECT *, regexp_matches(url, p) AS fits FROM
          (SELECT page_id, url, '(?s)^(.*?)://(.*?)/en/(.*?)$' AS p FROM pages))""")
def _(t: Tables):
    out = parse(t.pages, "url", Capture("Scheme"), "://", Capture("Host"), "/en/", Capture("Rest"))
    return out.select("page_id", "Scheme", "Host", "Rest")


_PARAMS = """(SELECT page_id, CASE WHEN contains(url, '?') THEN
    string_split(split_part(url, '?', 2), '&') ELSE [] END AS params FROM pages)"""


def _params(t: Tables):
    after = F.split(F.element_at(F.split("url", r"\?"), -1), "&")
    return t.pages.select("page_id", F.when(F.contains("url", F.lit("?")), after)
                          .otherwise(F.array().cast("array<string>")).alias("params"))


@query("X07_mv_expand", f"""SELECT page_id, unnest(CASE WHEN len(params) = 0 THEN [NULL] ELSE params END)
    AS params FROM {_PARAMS}""")
def _(t: Tables):
    return mv_expand(_params(t), "params")


@query("X08_mv_expand_lockstep", """SELECT doc_id, unnest(list_slice(a, 1, n)) AS a, unnest(list_slice(b, 1, n)) AS b
    FROM (SELECT *, least(len(a), len(b)) AS n FROM (
        SELECT doc_id, string_split(source, 'c') AS a, string_split(text, chr(10)) AS b FROM documents))""")
def _(t: Tables):
    arrays = t.documents.select("doc_id", F.split("source", "c").alias("a"), F.split("text", "\n").alias("b"))
    return mv_expand(arrays, "a", "b")


@query("X09_mv_expand_cast", """SELECT event_id, CAST(unnest(string_split(regexp_extract(props, '([0-9]+)', 1), '')) AS BIGINT)
    AS digit FROM events""")
def _(t: Tables):
    digits = F.split(F.regexp_extract("props", "([0-9]+)", 1), "")
    return mv_expand(t.events.select("event_id", digits.alias("digit")), "digit", to="long")


@query("X10_flatten_struct", """SELECT user_id, round(lo, 2) AS lo, round(hi, 2) AS hi FROM (
    SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY user_id)""")
def _(t: Tables):
    both = F.struct(F.round(F.min("value"), 2).alias("lo"), F.round(F.max("value"), 2).alias("hi"))
    return flatten_struct(t.events.groupBy("user_id").agg(both.alias("range")), "range")


@query("L1_top", "SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 25")
def _(t: Tables):
    return top(t.events.select("event_id", "value"), 25, "value", tiebreak=("event_id",))


@query("L1_top_ascending", """SELECT event_id, k FROM (SELECT event_id, CASE WHEN value > 20 THEN value END AS k FROM events)
    ORDER BY k ASC NULLS LAST, event_id LIMIT 10""")
def _(t: Tables):
    k = F.when(F.col("value") > 20, F.col("value"))
    return top(t.events.select("event_id", k.alias("k")), 10, "k", desc=False, tiebreak=("event_id",))


@query("L2_union", """SELECT event_id, value, user_id, NULL AS event_type FROM events WHERE event_type = 'error'
    UNION ALL SELECT event_id, value, NULL AS user_id, event_type FROM events WHERE event_type = 'view'""")
def _(t: Tables):
    errors = t.events.filter("event_type = 'error'").select("event_id", "value", "user_id")
    views = t.events.filter("event_type = 'view'").select("event_id", "value", "event_type")
    return union(errors, views)


@query("L2_union_tables_fuzzy", """SELECT user_id, count(*) AS n FROM events
    WHERE event_type IN ('error', 'click') GROUP BY user_id""")
def _(t: Tables):
    for kind in ("error", "click"):
        t.events.filter(F.col("event_type") == kind).createOrReplaceTempView(f"huntframe_{kind}")
    rows = union_tables(t.spark, "huntframe_error", "huntframe_click", "huntframe_absent", fuzzy=True)
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


# --- scans and sinks ---------------------------------------------------------------------------

@query("SRC1_scan", "SELECT event_id, user_id, value FROM events WHERE event_type = 'signup'")
def _(t: Tables):
    t.events.createOrReplaceTempView("huntframe_events")
    rows = scan(t.spark, "huntframe_events").filter(eq("event_type", "signup"))
    return rows.select("event_id", "user_id", "value")


@query("SRC1_scan_by_day", """SELECT event_id, value FROM events
    WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-12 06:00:00'""")
def _(t: Tables):
    path = scratch_path(t.spark, "events")
    write_events(t.events, path, time="ts")
    start = AS_OF - timedelta(days=20, hours=18)
    return scan_events(t.spark, path, start, start + timedelta(days=2), time="ts").select("event_id", "value")


@query("SRC2_SNK1_json_lines", "SELECT event_id, user_id, event_type, value, ts FROM events")
def _(t: Tables):
    path = scratch_path(t.spark, "jsonl")
    rows = t.events.select("event_id", "user_id", "event_type", "value", "ts")
    write_jsonl(rows, path)
    return scan_jsonl(t.spark, path, rows.schema)


@query("SRC3_json_documents", "SELECT item_id, text, length(text) AS n FROM benchmark")
def _(t: Tables):
    path = scratch_path(t.spark, "json")
    body = F.to_json(F.struct("item_id", "text", F.length("text").cast("long").alias("n")), {"pretty": "true"})
    t.benchmark.select(body.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    schema = "item_id long, text string, n long"
    return scan_json_documents(t.spark, path, schema)


@query("SRC4_whole_texts", "SELECT item_id, concat(text, chr(10)) AS text FROM benchmark")
def _(t: Tables):
    path = scratch_path(t.spark, "texts")
    t.benchmark.select(F.concat(F.col("item_id").cast("string"), F.lit("\n"), "text")).write.option(
        "maxRecordsPerFile", 1).text(path)
    files = scan_whole_texts(t.spark, path, "*.txt")
    return files.select(F.regexp_extract("text", r"^(\d+)\n", 1).cast("long").alias("item_id"),
                        F.regexp_replace("text", r"^\d+\n", "").alias("text"))


@query("SRC5_field_rows", """SELECT 'Field' || cast(p_partkey AS string) AS field FROM part WHERE p_size > 5""")
def _(t: Tables):
    path = scratch_path(t.spark, "markdown")
    mark = F.when(F.col("p_size") > 5, F.lit("**")).otherwise("")
    line = F.concat(F.lit("| "), mark, F.lit("Field"), F.col("p_partkey"), mark, F.lit(" | Optional | "),
                    F.col("p_name"), F.lit(" |"))
    t.part.select(line.alias("value")).write.text(path)
    return scan_field_rows(t.spark, path, "*.txt").select("field")


@query("SNK2_routed", """SELECT lang IN ('en', 'de') AS is_normalized, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars
    FROM documents GROUP BY 1""")
def _(t: Tables):
    path = scratch_path(t.spark, "routed")
    rows = t.documents.select("doc_id", "lang", "n_chars")
    write_routed(rows, path, any_of(eq("lang", "en"), eq("lang", "de")))
    schema = "doc_id long, lang string, n_chars long, is_normalized boolean"
    back = t.spark.read.schema(schema).json(path)
    return back.groupBy("is_normalized").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SNK3_append_results", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t: Tables):
    path = scratch_path(t.spark, "results")
    rows = t.orders.select("o_orderkey", "o_totalprice")
    append_results(rows.filter("o_totalprice > 200000"), path, "o_orderkey")
    return append_results(rows, path, "o_orderkey")
