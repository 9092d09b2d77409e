"""S: scalar functions, by group."""

from __future__ import annotations

from pyspark.sql import functions as F

from huntframe.functions import scalars as S
from huntframe.functions.durations import ago
from huntframe.queries.registry import AS_OF, Tables, address, joined, query


@query("S_strings", """SELECT p_partkey, concat(p_name, '/', p_brand, '/', coalesce(CASE WHEN p_size > 10 THEN p_type END, '')) AS cat,
    array_to_string(string_split(p_name, ' '), '-') AS dashed, string_split(p_brand, '#')[2] AS second,
    substr(p_name, 3, 4) AS mid, substr(p_name, greatest(length(p_name) - 2, 1), length(p_name)) AS tail,
    regexp_replace(p_name, '([a-z]+) ([a-z]+)', '\\2 \\1', 'g') AS swapped,
    lower(p_brand) AS low, upper(p_name) AS up,
    CASE WHEN regexp_matches(p_name, '(bo|ri)([a-z]+)') THEN regexp_extract(p_name, '(bo|ri)([a-z]+)', 2) END AS ex,
    CASE WHEN len(regexp_extract_all(p_name, '([aeiou])', 1)) > 0
        THEN array_to_string(regexp_extract_all(p_name, '([aeiou])', 1), ',') END AS vowels FROM part""")
def _(t: Tables):
    kind = F.when(F.col("p_size") > 10, F.col("p_type"))
    return joined(t.part.select(
        "p_partkey", S.strcat(F.col("p_name"), "/", F.col("p_brand"), "/", kind).alias("cat"),
        S.strcat_array(S.split("p_name", " "), "-").alias("dashed"),
        F.get(S.split("p_brand", "#", 1), F.lit(0)).alias("second"),
        S.substring("p_name", 2, 4).alias("mid"), S.substring("p_name", -3).alias("tail"),
        S.replace("p_name", r"([a-z]+) ([a-z]+)", r"\2 \1").alias("swapped"),
        S.tolower("p_brand").alias("low"), S.toupper("p_name").alias("up"),
        S.extract("(bo|ri)([a-z]+)", 2, "p_name").alias("ex"),
        S.extract_all("([aeiou])", "p_name").alias("vowels")), "vowels")


@query("S_trim", """SELECT p_partkey, regexp_replace(p_name, '^(?:r|e|s)+|(?:r|e|s)+$', '', 'g') AS trimmed FROM part""")
def _(t: Tables):
    return t.part.select("p_partkey", S.trim("r|e|s", "p_name").alias("trimmed"))


@query("S_parse_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.variant_get(S.parse_json("props"), "$.k", "long").alias("k"))


@query("S_parse_url", r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
    regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path,
    regexp_extract(url, '#(.*)$', 1) AS frag, coalesce(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages""")
def _(t: Tables):
    u = S.parse_url("url")
    return t.pages.select("page_id", u["Scheme"].alias("scheme"), u["Host"].alias("host"), u["Path"].alias("path"),
                          u["Fragment"].alias("frag"), F.coalesce(u["Query"]["page"], F.lit("")).alias("page"))


@query("S_parse_urlquery", """SELECT event_id, 'v' || cast(user_id AS string) AS a, event_type AS b, '' AS c FROM events""")
def _(t: Tables):
    text = F.concat(F.lit("a=first&b="), F.col("event_type"), F.lit("&c&a=v"), F.col("user_id"))
    q = S.parse_urlquery(text)
    return t.events.select("event_id", q["a"].alias("a"), q["b"].alias("b"), q["c"].alias("c"))


@query("S_parse_csv", """SELECT p_partkey, p_name AS first, 'say "' || p_brand || '", please' AS second, '' AS third,
    p_type AS fourth FROM part""")
def _(t: Tables):
    record = F.concat(F.col("p_name"), F.lit(',"say ""'), F.col("p_brand"), F.lit('"", please",,'), F.col("p_type"))
    cells = S.parse_csv(record)
    return t.part.select("p_partkey", *[F.get(cells, F.lit(i)).alias(n)
                                        for i, n in enumerate(("first", "second", "third", "fourth"))])


@query("S_parse_path", """SELECT p_partkey, 'C:' AS root, 'C:\\Tools\\' || p_brand AS folder, p_brand AS parent,
    p_name || '.exe' AS file, 'exe' AS ext FROM part""")
def _(t: Tables):
    p = S.parse_path(F.concat(F.lit("C:\\Tools\\"), F.col("p_brand"), F.lit("\\"), F.col("p_name"), F.lit(".exe")))
    return t.part.select("p_partkey", p["RootPath"].alias("root"), p["DirectoryPath"].alias("folder"),
                         p["DirectoryName"].alias("parent"), p["Filename"].alias("file"), p["Extension"].alias("ext"))


@query("S_time_filter", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL '3 days' AND ts < TIMESTAMP '2024-01-31'")
def _(t: Tables):
    return t.events.filter((F.col("ts") >= S.ago(AS_OF, "P3D")) & (F.col("ts") < S.now(AS_OF))).select("event_id")


@query("S_time_diff", f"""SELECT event_id, epoch_us(TIMESTAMP '{AS_OF}' - ts) / 3.6e9 AS hours,
    datediff('hour', ts, TIMESTAMP '{AS_OF}') AS crossed, datediff('day', ts, TIMESTAMP '{AS_OF}') AS days FROM events""")
def _(t: Tables):
    end = S.now(AS_OF)
    return t.events.select("event_id", S.datetime_diff("hour", end, "ts").alias("hours"),
                           S.datetime_diff("hour", end, "ts", boundaries=True).alias("crossed"),
                           S.datetime_diff("day", end, "ts", boundaries=True).alias("days"))


@query("S_time_add", """SELECT event_id, ts + INTERVAL '90 minutes' AS a, ts + INTERVAL '1 month' AS b,
    ts - INTERVAL '14 days' AS c FROM events""")
def _(t: Tables):
    return t.events.select("event_id", S.datetime_add("minute", 90, "ts").alias("a"),
                           S.datetime_add("month", 1, "ts").alias("b"), S.datetime_add("week", -2, "ts").alias("c"))


@query("S_time_calendar", """SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS d,
    (date_trunc('week', ts + INTERVAL '1 day') - INTERVAL '1 day')::TIMESTAMP AS w, date_trunc('month', ts)::TIMESTAMP AS m,
    date_trunc('year', ts)::TIMESTAMP AS y, (date_trunc('day', ts) + INTERVAL '1 day' - INTERVAL '1 microsecond')::TIMESTAMP AS ed,
    (date_trunc('week', ts + INTERVAL '1 day') + INTERVAL '6 days' - INTERVAL '1 microsecond')::TIMESTAMP AS ew,
    (date_trunc('month', ts) + INTERVAL '1 month' - INTERVAL '1 microsecond')::TIMESTAMP AS em,
    (date_trunc('year', ts) + INTERVAL '1 year' - INTERVAL '1 microsecond')::TIMESTAMP AS ey FROM events""")
def _(t: Tables):
    made = {"d": S.startofday("ts"), "w": S.startofweek("ts"), "m": S.startofmonth("ts"), "y": S.startofyear("ts"),
            "ed": S.endofday("ts"), "ew": S.endofweek("ts"), "em": S.endofmonth("ts"), "ey": S.endofyear("ts")}
    return t.events.select("event_id", *[c.cast("timestamp_ntz").alias(n) for n, c in made.items()])


@query("S_time_format", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS s, strftime(ts, '%d/%m/%y %I:%M %p') AS h FROM events""")
def _(t: Tables):
    return t.events.select("event_id", S.format_datetime("ts", "yyyy-MM-dd HH:mm:ss").alias("s"),
                           S.format_datetime("ts", "dd/MM/yy hh:mm tt").alias("h"))


@query("S_bin", """SELECT event_id, floor(value / 25) * 25 AS v, CAST(floor(user_id / 10) * 10 AS BIGINT) AS u,
    time_bucket(INTERVAL '15 minutes', ts) AS b FROM events""")
def _(t: Tables):
    return t.events.select("event_id", S.bin_number("value", 25).cast("double").alias("v"),
                           S.bin_number("user_id", 10).cast("long").alias("u"),
                           S.bin_time("ts", "PT15M", kind="timestamp_ntz").alias("b"))


@query("S_casts", """SELECT event_id, cast(user_id AS string) AS s, trunc(value)::BIGINT AS l, trunc(-value)::INT AS i,
    CASE WHEN value > 5 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) END AS d FROM events""")
def _(t: Tables):
    k = F.when(F.col("value") > 5, F.regexp_extract("props", "([0-9]+)", 1)).otherwise("n/a")
    return t.events.select("event_id", S.tostring("user_id").alias("s"),
                           S.tolong(F.col("value").cast("string")).alias("l"), S.toint(-F.col("value")).alias("i"),
                           S.todouble(k).alias("d"))


@query("S_conditionals", """SELECT event_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS a,
    CASE WHEN value > 100 THEN 'big' WHEN value > 20 THEN 'mid' ELSE 'small' END AS b,
    coalesce(CASE WHEN value > 30 THEN event_type END, 'none') AS c, greatest(value, user_id) AS hi,
    least(value, user_id) AS lo, abs(value - 50) AS off FROM events""")
def _(t: Tables):
    value = F.col("value")
    kind = F.when(value > 30, F.col("event_type")).otherwise("")
    return t.events.select(
        "event_id", S.iff(value > 50, "high", "low").alias("a"),
        S.case(value > 100, "big", value > 20, "mid", "small").alias("b"),
        S.coalesce(kind, F.lit("none")).alias("c"), S.max_of("value", "user_id").alias("hi"),
        S.min_of("value", "user_id").alias("lo"), F.abs(value - 50).alias("off"))


@query("S_arrays", """SELECT item_id, len(w) AS n, array_to_string(list_slice(w, 3, 5), ' ') AS mid,
    array_to_string(list_slice(w, greatest(len(w) - 2, 1), len(w)), ' ') AS tail,
    array_to_string(list_slice(w, 2, len(w) - 1), ' ') AS inner_words
    FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)""")
def _(t: Tables):
    words = F.split("text", " ")
    return t.benchmark.select(
        "item_id", S.array_length(words).cast("long").alias("n"),
        S.strcat_array(S.array_slice(words, 2, 4), " ").alias("mid"),
        S.strcat_array(S.array_slice(words, -3, -1), " ").alias("tail"),
        S.strcat_array(S.array_slice(words, 1, -2), " ").alias("inner_words"))


_IP = f"(SELECT c_custkey, {address()} AS ip FROM customer)"
_QUAD = "list_transform(string_split(ip, '.'), lambda x: CAST(x AS BIGINT))"


@query("S_ip", f"""SELECT c_custkey, q[1] * 16777216 + q[2] * 65536 + q[3] * 256 + q[4] AS n,
    q[1] * 16777216 + q[2] * 65536 AS net, q[1] = 10 AND q[2] < 16 AS low_ten, q[1] = 172 AND q[2] = 16 AS same_net,
    q[1] = 10 OR (q[1] = 172 AND q[2] BETWEEN 16 AND 31) OR (q[1] = 192 AND q[2] = 168) AS private
    FROM (SELECT c_custkey, {_QUAD} AS q FROM {_IP})""")
def _(t: Tables):
    seen = t.customer.selectExpr("c_custkey", f"{address()} AS ip")
    return seen.select(
        "c_custkey", S.parse_ipv4("ip").alias("n"), S.parse_ipv4_mask("ip", 16).alias("net"),
        S.ipv4_is_in_range("ip", "10.0.0.0/12").alias("low_ten"),
        S.ipv4_is_match("ip", F.lit("172.16.9.9"), 16).alias("same_net"), S.ipv4_is_private("ip").alias("private"))


@query("S_hash_sha256", "SELECT doc_id, sha256(text) AS h FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", S.hash_sha256("text").alias("h"))


@query("S_hash")
def _(t: Tables):
    return t.documents.select("doc_id", S.hash_long("text", 1000).alias("h"))


@query("S_ago_literal", f"SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '{ago(AS_OF, '12d')}'")
def _(t: Tables):
    return t.events.filter(F.col("ts") >= S.now(ago(AS_OF, "12d"))).agg(F.count(F.lit(1)).alias("n"))
