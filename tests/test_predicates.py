"""Each operator on literal rows: what it selects and what it leaves, with missing values."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plans import plan_of
from huntframe.functions import predicates as P
from huntframe.operators.stages import where


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([
        (1, "tool.exe /c LISTING /all", "Failure", 22, 1.5),
        (2, "reader.exe manual.txt", "Success", 443, float("nan")),
        (3, "Builder.EXE -zip Qk1NQQ=", "failure", 80, 50.0),
        (4, None, None, None, None),
        (5, "", "", 0, 0.0),
    ], "id int, cmd string, result string, port int, score double")


def ids(df):
    return sorted(r.id for r in df.collect())


CASES = {
    "==": ("result", "Failure", [1]), "!=": ("result", "Failure", [2, 3, 4, 5]),
    "=~": ("result", "FAILURE", [1, 3]), "!~": ("result", "FAILURE", [2, 4, 5]),
    "contains": ("cmd", "qk1nqq=", [3]), "!contains": ("cmd", "EXE", [4, 5]),
    "contains_cs": ("cmd", "Qk1N", [3]), "!contains_cs": ("cmd", ".exe", [3, 4, 5]),
    "startswith": ("cmd", "BUILD", [3]), "!startswith": ("cmd", "BUILD", [1, 2, 4, 5]),
    "startswith_cs": ("cmd", "Build", [3]), "!startswith_cs": ("cmd", "build", [1, 2, 3, 4, 5]),
    "endswith": ("cmd", ".TXT", [2]), "!endswith": ("cmd", ".TXT", [1, 3, 4, 5]),
    "endswith_cs": ("cmd", ".txt", [2]), "!endswith_cs": ("cmd", ".TXT", [1, 2, 3, 4, 5]),
    "in": ("result", ["Failure", "Success"], [1, 2]), "!in": ("result", ["Failure"], [2, 3, 4, 5]),
    "in~": ("result", ["FAILURE"], [1, 3]), "!in~": ("result", ["FAILURE"], [2, 4, 5]),
    "has": ("cmd", "listing", [1]), "!has": ("cmd", "listing", [2, 3, 4, 5]),
    "has_any": ("cmd", ["listing", "absent", "manual"], [1, 2]),
    "has_all": ("cmd", ["tool", "listing", "/all"], [1]),
    "has_cs": ("cmd", "LISTING", [1]), "!has_cs": ("cmd", "listing", [1, 2, 3, 4, 5]),
    "matches regex": ("cmd", r"^[a-z]+\.exe\s", [1, 2]),
    ">": ("port", 22, [2, 3]), "<": ("port", "80", [1, 5]), ">=": ("score", 1.5, [1, 3]), "<=": ("score", 50, [1, 3, 5]),
}


def test_all_31_tokens_are_there():
    assert len(P.BY_TOKEN) == 31 and set(CASES) == set(P.BY_TOKEN)


@pytest.mark.parametrize("token", CASES)
def test_token(rows, token):
    field, value, expected = CASES[token]
    assert ids(where(rows, P.compare(field, token, value))) == expected


def test_empty_string_is_equal_to_missing(rows):
    assert ids(where(rows, P.eq("result", ""))) == [4, 5]
    assert ids(where(rows, P.in_("result", ["", "Success"]))) == [2, 4, 5]


@pytest.mark.parametrize("term, text, hit", [
    (".tmp", "parcel.tmp", True), ("tmp", "parcel.tmp", True), ("arcel", "parcel.tmp", False),
    ("par", "parcel", False), ("zip", "builder -ZIP abc", True), ("-zip", "builder-zip", True),
    ("a_b", "x a_b y", True), ("a", "a_b", False), ("(x)", "f(x)", True), ("x\\Ey", "a x\\Ey b", True),
    ("café", "un CAFÉ noir", True), ("ab", "xab ab", True),
])
def test_has_term_borders(spark, term, text, hit):
    one = spark.createDataFrame([(text, term)], "t string, w string")
    assert one.select(P.has("t", term)).first()[0] is hit
    assert one.select(P.has("t", F.col("w"))).first()[0] is hit
    assert one.select(P.has_any("t", [term, "zzz"])).first()[0] is hit


def test_empty_term_is_never_found(rows):
    assert ids(where(rows, P.has("cmd", ""))) == []
    assert ids(where(rows, P.not_has("cmd", ""))) == [1, 2, 3, 4, 5]


def test_or_groups_and_nested_and(rows):
    assert ids(where(rows, P.any_of(P.eq("port", 22), P.eq("port", 443)))) == [1, 2]
    both = P.any_of(P.all_of(P.eq("result", "Failure"), P.eq("port", 22)),
                    P.all_of(P.eq("result", "Success"), P.eq("port", 80)))
    assert ids(where(rows, both)) == [1]


def test_columns_against_columns(spark):
    df = spark.createDataFrame([
        (1, datetime(2024, 1, 1, 1, 30), datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 2), "a", "A"),
        (2, datetime(2024, 1, 1, 3, 0), datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 2), "b", None),
    ], "id int, t timestamp, lo timestamp, hi timestamp, x string, y string")
    assert ids(where(df, P.ge("t", F.col("lo")), P.le("t", F.col("hi")))) == [1]
    assert ids(where(df, P.eq_ci("x", F.col("y")))) == [1]
    assert ids(where(df, P.ne("x", F.col("y")))) == [1, 2]


def test_time_bounds(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-02-01 00:00:00",), ("soon",), (None,)], "t string")
    assert where(df, P.gt("t", "2024-01-15T00:00:00")).count() == 1
    typed = df.select(F.col("t").try_cast("timestamp").alias("t"))
    assert where(typed, P.lt("t", datetime(2024, 1, 15))).count() == 1


def test_exact_forms_reach_the_scan(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for test, pushed in [
        (P.eq("lang", "en"), "EqualNullSafe(lang,en)"), (P.startswith_cs("source", "src1"), "StringStartsWith(source,src1)"),
        (P.in_("source", ["src1", "src2"]), "In(source, [src1,src2])"), (P.contains_cs("text", "The"), "StringContains(text,The)"),
        (P.has_cs("text", "The"), "StringContains(text,The)"),
    ]:
        assert pushed in plan_of(where(docs, test).select("doc_id"))
    events = spark.read.parquet(f"{folder}/events.parquet")
    assert "GreaterThan(value,50.0)" in plan_of(where(events, P.gt("value", 50)))
    assert "GreaterThanOrEqual(ts" in plan_of(where(events, P.ge("ts", datetime(2024, 1, 15))))
