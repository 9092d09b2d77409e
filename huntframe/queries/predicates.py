"""F: the comparison operators, one query each."""

from __future__ import annotations

from pyspark.sql import functions as F

from huntframe.functions import predicates as P
from huntframe.operators.stages import where
from huntframe.session import scratch_path
from huntframe.sources.term_index import rows_with_all, rows_with_any, write_term_index
from huntframe.queries.registry import Tables, query

# ``tag`` is missing for some rows, so every operator meets null.
_TAGGED = "(SELECT *, CASE WHEN lang <> 'fr' THEN source END AS tag FROM documents)"
_BORDER = "(^|[^A-Za-z0-9_])", "($|[^A-Za-z0-9_])"


def _term(word: str, options: str = "i") -> str:
    return f"regexp_matches(text, '{_BORDER[0]}{word}{_BORDER[1]}', '{options}')"


def _tagged(t: Tables):
    return t.documents.withColumn("tag", F.when(F.col("lang") != "fr", F.col("source")))


_ON_DOCUMENTS = {
    "F01_equals": (lambda: P.eq("tag", "src3"), "coalesce(tag, '') = 'src3'"),
    "F02_not_equals": (lambda: P.ne("tag", "src3"), "coalesce(tag, '') <> 'src3'"),
    "F03_equals_ci": (lambda: P.eq_ci("tag", "SRC3"), "lower(coalesce(tag, '')) = 'src3'"),
    "F04_not_equals_ci": (lambda: P.ne_ci("tag", "SRC3"), "lower(coalesce(tag, '')) <> 'src3'"),
    "F05_contains": (lambda: P.contains("text", "TION the"), "contains(lower(text), 'tion the')"),
    "F06_not_contains": (lambda: P.not_contains("tag", "C1"), "NOT contains(lower(coalesce(tag, '')), 'c1')"),
    "F07_contains_cs": (lambda: P.contains_cs("text", "The"), "contains(text, 'The')"),
    "F08_not_contains_cs": (lambda: P.not_contains_cs("tag", "c1"), "NOT contains(coalesce(tag, ''), 'c1')"),
    "F09_startswith": (lambda: P.startswith("tag", "SRC1"), "starts_with(lower(coalesce(tag, '')), 'src1')"),
    "F10_not_startswith": (lambda: P.not_startswith("tag", "SRC1"),
                           "NOT starts_with(lower(coalesce(tag, '')), 'src1')"),
    "F11_startswith_cs": (lambda: P.startswith_cs("tag", "src1"), "starts_with(coalesce(tag, ''), 'src1')"),
    "F12_not_startswith_cs": (lambda: P.not_startswith_cs("tag", "src1"),
                              "NOT starts_with(coalesce(tag, ''), 'src1')"),
    "F13_endswith": (lambda: P.endswith("tag", "C7"), "suffix(lower(coalesce(tag, '')), 'c7')"),
    "F14_not_endswith": (lambda: P.not_endswith("tag", "C7"), "NOT suffix(lower(coalesce(tag, '')), 'c7')"),
    "F15_endswith_cs": (lambda: P.endswith_cs("text", "."), "suffix(text, '.')"),
    "F16_not_endswith_cs": (lambda: P.not_endswith_cs("tag", "7"), "NOT suffix(coalesce(tag, ''), '7')"),
    "F17_in": (lambda: P.in_("tag", ["src1", "src2", ""]), "coalesce(tag, '') IN ('src1', 'src2', '')"),
    "F18_not_in": (lambda: P.not_in("tag", ["src1", "src2"]), "coalesce(tag, '') NOT IN ('src1', 'src2')"),
    "F19_in_ci": (lambda: P.in_ci("tag", ["SRC1", "Src2"]), "lower(coalesce(tag, '')) IN ('src1', 'src2')"),
    "F20_not_in_ci": (lambda: P.not_in_ci("tag", ["SRC1", "Src2"]),
                      "lower(coalesce(tag, '')) NOT IN ('src1', 'src2')"),
    "F21_has": (lambda: P.has("text", "THAT"), _term("that")),
    "F22_not_has": (lambda: P.not_has("text", "that"), f"NOT {_term('that')}"),
    "F23_has_any": (lambda: P.has_any("text", ["which", "nicht", "eau"]),
                    f"({_term('which')} OR {_term('nicht')} OR {_term('eau')})"),
    "F24_has_all": (lambda: P.has_all("text", ["the", "of", "is"]),
                    f"({_term('the')} AND {_term('of')} AND {_term('is')})"),
    "F25_has_cs": (lambda: P.has_cs("text", "The"), _term("The", "c")),
    "F26_not_has_cs": (lambda: P.not_has_cs("text", "The"), f"NOT {_term('The', 'c')}"),
    "F27_matches_regex": (lambda: P.matches_regex("text", r"[A-Z][a-z]+ [0-9]{2,}"),
                          "regexp_matches(text, '[A-Z][a-z]+ [0-9]{2,}')"),
    "F32_column_to_column": (lambda: P.contains_cs("text", F.col("lang")), "contains(text, lang)"),
}


def _register_document_filter(name, test, condition):
    @query(name, f"SELECT doc_id, tag FROM {_TAGGED} WHERE {condition}")
    def build(t: Tables):
        return where(_tagged(t), test()).select("doc_id", "tag")


# ``k`` is a number held as text, missing where the event value is small.
_NUMBERED = """(SELECT event_id, value, ts, user_id, event_type, CASE WHEN value > 5 THEN
    regexp_extract(props, '([0-9]+)', 1) ELSE 'n/a' END AS k FROM events)"""


def _numbered(t: Tables):
    k = F.when(F.col("value") > 5, F.regexp_extract("props", "([0-9]+)", 1)).otherwise("n/a")
    return t.events.withColumn("k", k)


_ON_EVENTS = {
    "F28_greater": (lambda: P.gt("k", 50), "coalesce(try_cast(k AS double) > 50, false)"),
    "F29_less": (lambda: P.lt("k", "50"), "coalesce(try_cast(k AS double) < 50, false)"),
    "F30_greater_or_equal": (lambda: P.ge("value", 49.5), "value >= 49.5"),
    "F31_less_or_equal": (lambda: P.le("ts", "2024-01-10 12:00:00"), "ts <= TIMESTAMP '2024-01-10 12:00:00'"),
    "F32_column_bracket": (lambda: P.gt("value", F.col("k").try_cast("double")),
                           "coalesce(value > try_cast(k AS double), false)"),
    "F33_and": (lambda: P.all_of(P.eq("event_type", "error"), P.gt("value", 20)),
                "event_type = 'error' AND value > 20"),
    "F34_or_group": (lambda: P.any_of(P.eq("event_type", "error"), P.lt("value", 3)),
                     "(event_type = 'error' OR value < 3)"),
    "F35_and_inside_or": (
        lambda: P.any_of(P.all_of(P.eq("event_type", "error"), P.gt("value", 90)),
                 P.all_of(P.eq("event_type", "view"), P.lt("value", 5))),
        "((event_type = 'error' AND value > 90) OR (event_type = 'view' AND value < 5))"),
    "F36_where": (lambda: P.all_of(P.any_of(P.eq("user_id", 7), P.eq("user_id", 11)),
                           P.ne("event_type", "view")),
                  "(user_id = 7 OR user_id = 11) AND event_type <> 'view'"),
}


def _register_event_filter(name, test, condition):
    @query(name, f"SELECT event_id, value FROM {_NUMBERED} WHERE {condition}")
    def build(t: Tables):
        return where(_numbered(t), test()).select("event_id", "value")


for _name, (_test, _condition) in _ON_DOCUMENTS.items():
    _register_document_filter(_name, _test, _condition)
for _name, (_test, _condition) in _ON_EVENTS.items():
    _register_event_filter(_name, _test, _condition)


# --- whole terms by a stored index -------------------------------------------------------------

def _indexed(t: Tables, pick, terms):
    path = scratch_path(t.spark, "term-index")
    documents = t.documents.select("doc_id", "text")
    write_term_index(documents, "doc_id", "text", path, bands=32)
    return pick(documents, "doc_id", "text", path, terms).select("doc_id")


# Terms from a table: a word of some items, two neighbouring words of the others.
_WORDS = "string_split(lower(regexp_replace(text, '[^A-Za-z ]', '', 'g')), ' ')"
_TERM_TABLE = f"""(SELECT DISTINCT CASE WHEN item_id % 2 = 0 THEN w[3] ELSE concat(w[1], ' ', w[2]) END AS term
    FROM (SELECT item_id, {_WORDS} AS w FROM benchmark))"""


@query("F23_has_any_indexed", f"""SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM {_TERM_TABLE}
    WHERE term <> '' AND regexp_matches(lower(text), concat('(^|[^a-z0-9_])', term, '($|[^a-z0-9_])')))""")
def _(t: Tables):
    w = F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]", "")), " ")
    terms = t.benchmark.select(F.when(F.col("item_id") % 2 == 0, F.get(w, F.lit(2))).otherwise(
        F.concat_ws(" ", F.get(w, F.lit(0)), F.get(w, F.lit(1)))).alias("term"))
    return _indexed(t, rows_with_any, terms)


@query("F24_has_all_indexed", f"SELECT doc_id FROM documents WHERE {_term('the')} AND {_term('of')} AND {_term('is')}")
def _(t: Tables):
    return _indexed(t, rows_with_all, t.spark.createDataFrame([("the",), ("OF",), ("is",)], "term string"))


@query("F21_has_indexed", f"SELECT doc_id FROM documents WHERE {_term('that')}")
def _(t: Tables):
    return _indexed(t, rows_with_any, t.spark.createDataFrame([("THAT",)], "term string"))
