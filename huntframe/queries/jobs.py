"""B: corpus and evaluation jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from huntframe.plans import corpus as C
from huntframe.plans import evaluation as E
from huntframe.plans import retrieval as R
from huntframe.plans.conformance import conform, conformance_report, field_reference
from huntframe.session import scratch_path
from huntframe.queries.registry import RULES_SQL, Tables, joined, query, rounded, rules
from huntframe.sources.schemas import event_schema, schemas_of_reference

# --- corpus ------------------------------------------------------------------------------------

_TOLD = "trim(description_raw, ' ' || chr(9) || chr(10) || chr(13))"


@query("B01_usable_rules", rf"""SELECT rule_id, regexp_matches(query, '\b(im[A-Z]\w*|_Im_\w*|ASim\w*)\b') AS is_normalized
    FROM {RULES_SQL} WHERE length({_TOLD}) >= 20 AND NOT contains(description_raw, '{{{{') AND NOT contains(query, '{{{{')""")
def _(t: Tables):
    return C.usable_rules(rules(t), "description_raw", "query").select("rule_id", "is_normalized")


_CLAUSE = "split_part(substr(query, instr(query, ' by ') + 4), '|', 1)"
_FLAT = f"regexp_replace({_CLAUSE}, '\\([^()]*\\)', '', 'g')"
_TIERED = f"""(SELECT *, CASE WHEN contains(query, '| join')
        OR (contains(query, '| summarize') AND contains(query, ' by ')
            AND length({_FLAT}) - length(replace({_FLAT}, ',', '')) + 1 >= 3)
        OR (NOT contains(query, '| summarize')
            AND (length(query) - length(replace(query, '| where', ''))) / 7 >= 5) THEN 'complex'
    WHEN contains(query, '| summarize') THEN 'moderate' ELSE 'simple' END AS tier FROM {RULES_SQL})"""


@query("B02_complexity_tier", f"SELECT rule_id, tier FROM {_TIERED}")
def _(t: Tables):
    return rules(t).select("rule_id", C.complexity_tier("query").alias("tier"))


_KINDS = {"Dns": "PROMO", "WebSession": "STANDARD", "NetworkSession": "SMALL"}


@query("B03_field_reference", """SELECT event_type, string_agg(field, ',' ORDER BY field) AS fields FROM (
    SELECT DISTINCT event_type, concat(p_brand, ' ', cast(p_size AS string)) AS field FROM part JOIN (VALUES
        ('Dns', 'ECONOMY'), ('Dns', 'PROMO'), ('WebSession', 'ECONOMY'), ('WebSession', 'STANDARD'),
        ('WebSession', 'SMALL'), ('NetworkSession', 'ECONOMY'), ('NetworkSession', 'SMALL')) AS v(event_type, doc)
    ON p_type = doc) GROUP BY event_type""")
def _(t: Tables):
    rows = t.part.select(F.col("p_type").alias("document"),
                         F.concat(F.col("p_brand"), F.lit(" "), F.col("p_size")).alias("field"))
    return joined(field_reference(rows, _KINDS, "ECONOMY", {"WebSession": "NetworkSession"}), "fields")


_FIELDS = {
    "AuthenticationEvent": ["EventResult", "SrcIpAddr", "TimeGenerated"],
    "NetworkSessionEvent": ["EventResult", "SrcIpAddr", "TimeGenerated", "DvcHostname"],
    "DnsEvent": ["EventResult", "SrcIpAddr", "DvcHostname"],
}
_ALLOWED = "CASE event_type " + " ".join(
    f"WHEN '{k}' THEN {v!r}" for k, v in _FIELDS.items()) + " END"


@query("B04_audit", f"""SELECT rule_id, event_type, array_to_string(bad, ',') AS unknown_names,
    CASE WHEN event_type IS NULL THEN 'NO_EVENT_TYPE_DETECTED' WHEN len(bad) > 0 THEN 'UNKNOWN_TOKENS' ELSE '' END AS flags
    FROM (SELECT *, CASE WHEN event_type IS NULL THEN [] ELSE list_filter(
            ['DvcHostname', 'EventResult', 'SrcIpAddr', 'TimeGenerated', 'Unheard', 'imDns'],
            lambda x: contains(query, x) AND NOT list_contains({_ALLOWED}, x)) END AS bad
    FROM (SELECT *, CASE WHEN contains(query, 'imAuthentication') THEN 'AuthenticationEvent'
            WHEN contains(query, 'ASimNetworkSession') THEN 'NetworkSessionEvent'
            WHEN contains(query, '_Im_Dns') OR contains(query, 'imDns') THEN 'DnsEvent' END AS event_type
        FROM {RULES_SQL}))""")
def _(t: Tables):
    audited = C.audit_rules(rules(t), "query", _FIELDS)
    return joined(audited.select("rule_id", "event_type", "unknown_names", "flags"), "unknown_names", "flags")


@query("B05_stratified_split", """SELECT lang, doc_id, CASE WHEN rn <= round_even(n * 0.2, 0) THEN 'test' ELSE 'train' END AS split
    FROM (SELECT lang, doc_id, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang
        ORDER BY md5('42|' || cast(doc_id AS string)), doc_id) AS rn FROM (SELECT DISTINCT lang, doc_id FROM documents))""")
def _(t: Tables):
    return C.stratified_split(t.documents, "doc_id", "lang", 0.2, 42)


@query("B06_evaluation_pool", f"""WITH fresh AS (SELECT * FROM {_TIERED} WHERE source NOT IN ('src0', 'src1')
        AND length({_TOLD}) >= 20 AND NOT contains(query, '{{{{') AND NOT contains(lower(description_raw), 'deprecated')),
    small AS (SELECT rule_id, tier FROM fresh WHERE tier <> 'complex'),
    hard AS (SELECT rule_id, tier, row_number() OVER (ORDER BY md5('42|' || rule_id), rule_id) AS rn
        FROM fresh WHERE tier = 'complex')
    SELECT rule_id, tier FROM small UNION ALL
    SELECT rule_id, tier FROM hard WHERE rn + (SELECT count(*) FROM small) <= 600""")
def _(t: Tables):
    used = rules(t).filter(F.col("source").isin("src0", "src1"))
    return C.evaluation_pool(rules(t), used, "rule_id", "description_raw", "query", 600).select("rule_id", "tier")


@query("B07_verified_pairs", """SELECT d.doc_id, phrasing, description FROM (
    SELECT doc_id, 'original' AS phrasing, text AS description FROM documents UNION ALL
    SELECT doc_id, 'casual', lower(source) FROM documents UNION ALL
    SELECT doc_id, 'sop_imperative', concat('If ', lang, ' then ', source) FROM documents) d
    JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1""")
def _(t: Tables):
    verdicts = t.labels.select("doc_id", F.when(F.col("quality") == 1, "keep").otherwise("discard").alias("verdict"))
    variants = t.documents.select("doc_id", F.lower("source").alias("casual"), F.concat(
        F.lit("If "), "lang", F.lit(" then "), "source").alias("sop_imperative"))
    return C.verified_pairs(t.documents, verdicts, variants, "doc_id", "text")


@query("B18_chunks", """SELECT doc_id, piece, source || chr(10) || chr(10) || substr(body, (piece - 1) * 4000 + 1, 4000) AS text FROM (
    SELECT doc_id, source, body, unnest(range(1, (length(body) + 3999) // 4000 + 1)) AS piece FROM (
    SELECT doc_id, source, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS body FROM documents) WHERE length(body) >= 50)""")
def _(t: Tables):
    page = F.concat(
        F.lit("---\nauthor: x\nms.topic: y\n---\n> [!INCLUDE applies to a]\n"),
        F.lit(":::moniker range=a\nold\n:::moniker-end\n"), F.col("text"),
        F.lit("\n> [!div class=b]\n> <a href=\"https://x\">Run</a>\n:::image type=c source=d.png:::\n"))
    pages = t.documents.select("doc_id", "source", page.alias("page"))
    return R.chunks(pages, "doc_id", "page", title="source")


@query("B19_split_camel_case", r"""SELECT p_partkey, regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g') AS words FROM (
    SELECT p_partkey, concat(p_type, 'Event', replace(p_brand, '#', ''), 'IPAddr') AS name FROM part)""")
def _(t: Tables):
    name = F.concat("p_type", F.lit("Event"), F.regexp_replace("p_brand", "#", ""), F.lit("IPAddr"))
    return t.part.select("p_partkey", C.split_camel_case(name).alias("words"))


_CONSTRUCTS = {
    "where": (r"\| where", "supported"), "summarize": (r"\| summarize", "supported"),
    "join": (r"\| join", "supported"), "bin": (r"\bbin\(", "supported"), "extend": (r"\| extend", "supported"),
    "many filters": (r"(\| where.*){6}", "partial"), "unlisted": (r"\bUnheard\b", "not supported"),
    "render": (r"\| render", "not supported"),
}
_COUNTED = " UNION ALL ".join(
    f"SELECT '{n}' AS construct, '{s}' AS status, count(*) FILTER (regexp_matches(query, '{r}')) AS rules FROM {RULES_SQL}"
    for n, (r, s) in _CONSTRUCTS.items())


@query("B20_construct_frequency", f"SELECT * FROM ({_COUNTED}) WHERE rules >= 5")
def _(t: Tables):
    return C.construct_coverage(rules(t), "query", _CONSTRUCTS)


@query("B20_coverage_share", f"""SELECT status, count(*) AS constructs, count(*) / sum(count(*)) OVER () AS share
    FROM ({_COUNTED}) WHERE rules >= 5 GROUP BY status""")
def _(t: Tables):
    return C.coverage_share(C.construct_coverage(rules(t), "query", _CONSTRUCTS))


_NAMES = ["Large Gear", "small bolt", "RED WIDGET", "blue ring", "greenish gizmo", "tiny ring"]


@query("B21_closest_name", f"""SELECT p_name, arg_min(name, d * 100 + i) AS closest FROM (
    SELECT p_name, name, i, levenshtein(lower(p_name), lower(name)) AS d
    FROM (SELECT DISTINCT p_name FROM part), (SELECT unnest({_NAMES!r}) AS name, unnest(range({len(_NAMES)})) AS i))
    GROUP BY p_name""")
def _(t: Tables):
    return C.closest_names(t.part, "p_name", _NAMES)


_VALUE = """CASE WHEN n_chars % 4 = 0 THEN concat(lang, 'tool.exe') WHEN n_chars % 4 = 1 THEN concat(source, '.dll')
    WHEN n_chars % 4 = 2 THEN substr(text, 5, 9) ELSE 'NXDOMAIN' END"""
_DESCRIPTION = "CASE WHEN n_chars % 3 = 0 THEN concat(text, ' ', source) ELSE text END"


@query("B22_ungrounded_literals", f"""SELECT doc_id, NOT (length(v) < 4 OR v = 'nxdomain' OR contains(d, v)
        OR (suffix(v, '.exe') AND contains(d, left(v, length(v) - 4)))
        OR (suffix(v, '.dll') AND contains(d, left(v, length(v) - 4)))) AS ungrounded FROM (
    SELECT doc_id, lower(trim({_VALUE}, ' ' || chr(9) || chr(10) || chr(13))) AS v, lower({_DESCRIPTION}) AS d FROM documents)""")
def _(t: Tables):
    pairs = t.documents.selectExpr("doc_id", f"{_VALUE} AS v", f"{_DESCRIPTION} AS d")
    return pairs.select("doc_id", C.is_ungrounded("v", "d").alias("ungrounded"))


def _as_dns(t: Tables):
    return t.events.withColumnsRenamed({"ts": "TimeGenerated", "event_type": "EventType", "props": "DnsQuery"})


@query("B23_conform", """SELECT TimeGenerated, EventType, DnsQuery, EventCount FROM (
    SELECT ts AS TimeGenerated, event_type AS EventType, props AS DnsQuery, CAST(NULL AS INT) AS EventCount FROM events)""")
def _(t: Tables):
    out = conform(_as_dns(t), event_schema("Dns"))
    return out.select(F.col("TimeGenerated").cast("timestamp_ntz").alias("TimeGenerated"), "EventType", "DnsQuery", "EventCount")


# The reference is derived from the events: a field per kind of event and ending, and common ones.
@query("B23_conform_by_reference", """SELECT ts AS TimeGenerated, event_type AS EventType, CAST(event_id AS BIGINT) AS ErrorCount,
    CAST(NULL AS TIMESTAMP) AS PurchaseTime, CAST(value AS VARCHAR) IS NOT NULL AS has_name, user_id FROM events""")
def _(t: Tables):
    kinds = t.events.select(F.initcap("event_type").alias("kind")).distinct()
    own = kinds.select(F.lit("dns.md").alias("document"), F.explode(F.array(
        F.concat("kind", F.lit("Count")), F.concat("kind", F.lit("Time")), F.concat("kind", F.lit("Name")))).alias("field"))
    common = kinds.select(F.lit("common.md").alias("document"), F.explode(F.array(F.lit("TimeGenerated"), F.lit("EventType"))).alias("field"))
    schema = schemas_of_reference(field_reference(own.union(common.distinct()), {"Dns": "dns.md"}, "common.md"))["Dns"]
    rows = t.events.select(F.col("ts").alias("TimeGenerated"), F.col("event_type").alias("EventType"), F.col("event_id").cast("string").alias("ErrorCount"),
                           F.col("value").alias("ClickName"), "user_id")
    out = conform(rows, schema, keep_unknown=True)
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("TimeGenerated", "PurchaseTime")}
    return out.withColumns(times).select("TimeGenerated", "EventType", "ErrorCount", "PurchaseTime", F.col("ClickName").isNotNull().alias("has_name"), "user_id")


@query("B23_conformance_report", """SELECT * FROM (SELECT 'TimeGenerated' AS "column", 'ok' AS status, count(ts) AS filled FROM events
    UNION ALL SELECT 'EventType', 'ok', count(event_type) FROM events UNION ALL SELECT 'DnsQuery', 'ok', count(props) FROM events
    UNION ALL SELECT 'event_id', 'unknown', count(event_id) FROM events UNION ALL SELECT 'user_id', 'unknown', count(user_id) FROM events
    UNION ALL SELECT 'value', 'unknown', count(value) FROM events UNION ALL SELECT 'SrcIpAddr', 'missing', 0)""")
def _(t: Tables):
    report = conformance_report(_as_dns(t), event_schema("Dns"))
    return report.filter((F.col("status") != "missing") | (F.col("column") == "SrcIpAddr"))


# --- evaluation --------------------------------------------------------------------------------

_LABELED = "(SELECT * FROM labels JOIN documents USING (doc_id))"


def _labeled(t: Tables):
    return t.labels.join(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id")


@query("B08_validity_rate", f"""SELECT lang, count(*) AS total, count(*) FILTER (quality = 1) AS passed,
    count(*) FILTER (quality = 1) / count(*) AS rate FROM {_LABELED} GROUP BY ROLLUP (lang)""")
def _(t: Tables):
    return E.validity_rate(_labeled(t), F.col("quality") == 1, ["lang"])


@query("B09_recovery_rate", f"""SELECT lang, count(*) FILTER (f) AS failed_first, count(*) FILTER (f AND quality = 1) AS recovered,
    CASE WHEN count(*) FILTER (f) = 0 THEN 0.0 ELSE count(*) FILTER (f AND quality = 1) / count(*) FILTER (f) END AS rate
    FROM (SELECT *, NOT (quality = 1 AND 1 + n_chars % 3 = 1) AS f FROM {_LABELED}) GROUP BY lang""")
def _(t: Tables):
    return E.recovery_rate(_labeled(t), F.col("quality") == 1, 1 + F.col("n_chars") % 3, ["lang"])


_PAIRED = """SELECT {by} count(*) FILTER (a AND b) AS "both", count(*) FILTER (a AND NOT b) AS a_only,
    count(*) FILTER (b AND NOT a) AS b_only, count(*) FILTER (NOT a AND NOT b) AS neither
    FROM (SELECT *, quality = 1 AS a, n_chars > 1000 AS b FROM """ + _LABELED + ") {group}"
_BINOMIAL = """list_sum(list_transform(range(least(a_only, b_only) + 1),
    lambda i: gamma(n + 1) / (gamma(i + 1) * gamma(n - i + 1)))) / pow(2, n)"""
# Upper chi-square tail by a rational approximation of erfc, good to 1.5e-7.
_T = "(1 / (1 + 0.3275911 * x))"
_TAIL = f"""{_T} * (0.254829592 + {_T} * (-0.284496736 + {_T} * (1.421413741 + {_T} * (-1.453152027
    + {_T} * 1.061405429)))) * exp(-x * x)"""


def _mcnemar_sql(by: str, group: str) -> str:
    table = _PAIRED.format(by=by, group=group)
    return f"""SELECT {by} "both", a_only, b_only, neither, CASE WHEN n < 25 THEN 'exact' ELSE 'chi-square' END AS test,
        round(CASE WHEN n < 25 THEN least(1.0, 2 * {_BINOMIAL}) ELSE {_TAIL} END, 4) AS p_value FROM (
        SELECT *, a_only + b_only AS n, sqrt(pow(abs(a_only - b_only) - 1, 2) / greatest(a_only + b_only, 1) / 2) AS x
        FROM ({table}))"""


@query("B10_mcnemar", _mcnemar_sql("", ""))
def _(t: Tables):
    return rounded(E.mcnemar(_labeled(t), F.col("quality") == 1, F.col("n_chars") > 1000), 4, "p_value")


@query("B10_mcnemar_by_group", _mcnemar_sql("source,", "GROUP BY source"))
def _(t: Tables):
    out = E.mcnemar(_labeled(t), F.col("quality") == 1, F.col("n_chars") > 1000, ["source"])
    return rounded(out, 4, "p_value")


@query("B11_bootstrap_ci")
def _(t: Tables):
    return E.bootstrap_ci(t.labels, F.col("quality"))


# For a mean, the percentile interval lies near mean -/+ 1.96 standard errors.
@query("B11_bootstrap_near_normal", """SELECT count(*) AS n, round(avg(n_chars), 6) AS mean, true AS low_fits, true AS high_fits
    FROM documents""")
def _(t: Tables):
    normal = t.documents.agg((1.96 * F.stddev_pop("n_chars") / F.sqrt(F.count("n_chars"))).alias("half"))
    out = E.bootstrap_ci(t.documents, F.col("n_chars")).withColumn("half", normal.scalar())
    fits = [(F.abs(F.abs(F.col("mean") - F.col(side)) - F.col("half")) < 0.15 * F.col("half")).alias(f"{side}_fits")
            for side in ("low", "high")]
    return out.select("n", F.round("mean", 6).alias("mean"), *fits)


@query("B12_scorecard", f"""SELECT source, count(*) AS n, count(*) FILTER (quality = 1) / count(*) AS completion,
    count(*) FILTER (fire) / nullif(count(fire), 0) AS fire, count(*) FILTER (nofire) / nullif(count(nofire), 0) AS nofire
    FROM (SELECT *, CASE WHEN quality = 1 THEN toxic = 0 END AS fire, CASE WHEN toxic = 1 THEN n_chars > 500 END AS nofire
    FROM {_LABELED}) GROUP BY source""")
def _(t: Tables):
    cases = _labeled(t).select(
        "source", (F.col("quality") == 1).alias("completed"),
        F.when(F.col("quality") == 1, F.col("toxic") == 0).alias("fire_ok"),
        F.when(F.col("toxic") == 1, F.col("n_chars") > 500).alias("nofire_ok"))
    return E.scorecard(cases, "source", "completed", "fire_ok", "nofire_ok")


@query("B13_cost_and_latency", """SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS avg_tokens,
    round(avg(n_chars / 100.0), 4) AS avg_seconds, round(quantile_cont(n_chars / 100.0, 0.5), 4) AS median_seconds,
    round(quantile_cont(n_chars / 100.0, 0.9), 4) AS p90_seconds FROM documents GROUP BY lang""")
def _(t: Tables):
    cases = t.documents.select("lang", "n_chars", (F.col("n_chars") / 100.0).alias("seconds"))
    out = E.cost_and_latency(cases, "lang", "n_chars", "seconds")
    return rounded(out, 4, "avg_tokens", "avg_seconds", "median_seconds", "p90_seconds")


_SCORED = f"(SELECT quality + 2 * toxic AS a, CASE WHEN n_chars > 3000 THEN 3 ELSE quality END AS b FROM {_LABELED})"


@query("B14_rater_agreement", f"""WITH s AS {_SCORED}, lv AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (
        SELECT a AS v FROM s UNION SELECT b FROM s)),
    p AS (SELECT x.i AS ia, y.i AS ib FROM s JOIN lv x ON s.a = x.v JOIN lv y ON s.b = y.v),
    ra AS (SELECT ia AS i, count(*) / (SELECT count(*) FROM p) AS f FROM p GROUP BY ia),
    rb AS (SELECT ib AS i, count(*) / (SELECT count(*) FROM p) AS f FROM p GROUP BY ib),
    e AS (SELECT sum((ra.i <> rb.i)::INT * ra.f * rb.f) AS e0, sum(abs(ra.i - rb.i) * ra.f * rb.f) AS e1,
        sum(pow(ra.i - rb.i, 2) * ra.f * rb.f) AS e2 FROM ra, rb),
    o AS (SELECT count(*) AS n, avg((ia = ib)::INT) AS agreement, avg(abs(ia - ib)) AS o1, avg(pow(ia - ib, 2)) AS o2 FROM p)
    SELECT n, round(agreement, 8) AS agreement, round(1 - (1 - agreement) / e0, 8) AS kappa,
        round(1 - o1 / e1, 8) AS kappa_linear, round(1 - o2 / e2, 8) AS kappa_quadratic FROM o, e""")
def _(t: Tables):
    b = F.when(F.col("n_chars") > 3000, 3).otherwise(F.col("quality"))
    pairs = _labeled(t).select((F.col("quality") + 2 * F.col("toxic")).alias("a"), b.alias("b"))
    return rounded(E.rater_agreement(pairs, "a", "b"), 8, "agreement", "kappa", "kappa_linear", "kappa_quadratic")


@query("B15_replication_summary", f"""SELECT runs, round(median, 8) AS median, round(q1, 8) AS q1, round(q3, 8) AS q3,
    round(low, 8) AS low, round(high, 8) AS high, round(q3 - q1, 8) AS iqr FROM (
    SELECT count(*) AS runs, quantile_cont(r, 0.5) AS median, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.75) AS q3,
    min(r) AS low, max(r) AS high FROM (SELECT source, avg(quality) AS r FROM {_LABELED} GROUP BY source))""")
def _(t: Tables):
    runs = _labeled(t).groupBy("source").agg(F.avg("quality").alias("rate"))
    return rounded(E.replication_summary(runs, "rate"), 8, "median", "q1", "q3", "low", "high", "iqr")


@query("B16_confusion", """SELECT quality = 1 AS manual_pass, count(*) FILTER (toxic = 0) AS predicted_true,
    count(*) FILTER (toxic <> 0) AS predicted_false FROM labels GROUP BY 1""")
def _(t: Tables):
    cases = t.labels.select((F.col("quality") == 1).alias("manual_pass"), (F.col("toxic") == 0).alias("verifier_pass"))
    return E.confusion(cases, "manual_pass", "verifier_pass")


_SCORES = f"""(SELECT doc_id, unnest(['rater1', 'rater1', 'rater2', 'rater2']) AS rater,
    unnest(['base', 'rag', 'base', 'rag']) AS cond,
    unnest([quality + 1, quality + toxic, CAST(n_chars % 4 AS INT), CAST(n_chars % 3 AS INT)]) AS score FROM {_LABELED})"""


@query("B24_wins", f"""SELECT rater, cond AS condition, CAST(sum(score) AS BIGINT) AS total,
    count(*) FILTER (score = best) AS best_or_tied FROM (
    SELECT *, max(score) OVER (PARTITION BY doc_id, rater) AS best FROM {_SCORES}) GROUP BY rater, cond""")
def _(t: Tables):
    def entry(rater, condition, score):
        return F.struct(F.lit(rater).alias("rater"), F.lit(condition).alias("condition"), score.cast("int").alias("score"))

    n, q, x = F.col("n_chars"), F.col("quality"), F.col("toxic")
    scores = _labeled(t).select("doc_id", F.inline(F.array(
        entry("rater1", "base", q + 1), entry("rater1", "rag", q + x),
        entry("rater2", "base", n % 4), entry("rater2", "rag", n % 3))))
    return E.wins_by_condition(scores, "doc_id", "rater", "condition", "score")


# --- retrieval ---------------------------------------------------------------------------------

STOP_WORDS = ["the", "of", "and", "to", "in", "is", "it", "that", "for", "on", "with", "as", "was", "by", "an", "at"]


def _terms_sql(table: str, key: str) -> str:
    words = f"""SELECT {key} AS k, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
        lambda w: NOT list_contains({STOP_WORDS!r}, w)) AS ws FROM {table}"""
    return f"""SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(ws) AS term FROM ({words}) UNION ALL
        SELECT k, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS term FROM ({words}))
        GROUP BY k, term"""


_RETRIEVAL = f"""WITH dt AS ({_terms_sql('documents', 'doc_id')}), qt AS ({_terms_sql('benchmark', 'item_id')}),
    vocab AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM dt GROUP BY term
        ),
    dw AS (SELECT k, term, tf * idf AS w FROM dt JOIN vocab USING (term)),
    qw AS (SELECT k, term, tf * idf AS w FROM qt JOIN vocab USING (term)),
    dn AS (SELECT k, sqrt(sum(w * w)) AS norm FROM dw GROUP BY k), qn AS (SELECT k, sqrt(sum(w * w)) AS norm FROM qw GROUP BY k),
    s AS (SELECT qw.k AS item_id, dw.k AS doc_id, sum(qw.w * dw.w) / any_value(qn.norm) / any_value(dn.norm) AS score
        FROM qw JOIN dw USING (term) JOIN dn ON dn.k = dw.k JOIN qn ON qn.k = qw.k GROUP BY qw.k, dw.k)"""


@query("B17_tfidf_search", _RETRIEVAL + """ SELECT item_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *,
    row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 3""")
def _(t: Tables):
    index = R.build_index(t.documents, "doc_id", "text", STOP_WORDS, path=scratch_path(t.spark, "tfidf"))
    found = R.search(index, t.benchmark, "item_id", "text", 3)
    return rounded(found.withColumn("rank", F.col("rank").cast("long")), 6, "score")


@query("B17_tfidf_vocabulary", _RETRIEVAL + " SELECT term, round(idf, 9) AS idf FROM vocab")
def _(t: Tables):
    return rounded(R.build_index(t.documents, "doc_id", "text", STOP_WORDS).vocabulary, 9, "idf")


# --- near names and intervals by group -----------------------------------------------------------

# Values that are names with a letter left out, doubled or replaced, and names as they are.
_VALUE_OF_NAME = """CASE p_partkey % 4 WHEN 0 THEN concat(substr(p_name, 1, 3), substr(p_name, 5)) WHEN 1 THEN concat(upper(p_name), 'xx')
    WHEN 2 THEN concat('q', p_name, 'zz') ELSE p_name END"""


@query("B21_closest_within", f"""SELECT v, arg_min(name, (d, name)) FILTER (d IS NOT NULL) AS closest, min(d) AS distance FROM (SELECT v, name, CASE WHEN d <= 2 THEN d END AS d
    FROM (SELECT v, name, levenshtein(lower(v), lower(name)) AS d FROM (SELECT DISTINCT {_VALUE_OF_NAME} AS v FROM part),
        (SELECT DISTINCT p_name AS name FROM part))) GROUP BY v""")
def _(t: Tables):
    values = t.part.selectExpr(f"{_VALUE_OF_NAME} AS v")
    return C.closest_within(values, "v", t.part.select("p_name").distinct(), "p_name", 2)


_DRAWS = 200


@query("B11_bootstrap_by_group", f"""SELECT source, count(DISTINCT doc_id) AS n, round(any_value(mean), 6) AS mean, round(any_value(low), 6) AS low,
    round(any_value(high), 6) AS high FROM documents JOIN (SELECT source, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM (
        SELECT source, r, sum(w * n_chars) / nullif(sum(w), 0) AS m FROM (SELECT *, {E.weight_of_draw('u')} AS w FROM (
            SELECT source, n_chars, r, {E.poisson_weight('doc_id', 'r')} AS u FROM documents, (SELECT unnest(range({_DRAWS})) AS r)))
        GROUP BY source, r) GROUP BY source) USING (source) JOIN (SELECT source, avg(n_chars) AS mean FROM documents GROUP BY source) USING (source)
    GROUP BY source""")
def _(t: Tables):
    return rounded(E.bootstrap_by(t.documents, ["source"], "n_chars", "doc_id", _DRAWS), 6, "mean", "low", "high")
