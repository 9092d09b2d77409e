import random
import re

import pytest
from plans import plan_of
from pyspark.sql import functions as F

from huntframe.functions.predicates import has, has_all, has_any
from huntframe.sources.term_index import look_up, rows_with_all, rows_with_any, write_term_index

TEXTS = ["The quick.brown fox", "c:\\Windows\\cmd.exe /c WHOAMI", "cache.tmp", "tmpfile", "été d'été", "a_b a-b", "", None, "-- ::",
         "KK k", "x" * 3000 + " end", "[a] (b|c) \\E", "one\ttwo\nthree", "Straße 12", "foo.bar.", ".tmp", "cmd", "a  b"]
TERMS = ["quick", "QUICK.brown", "uick", "cmd.exe", ".tmp", "tmp", "été", "t", "é", "a_b", "a-b", "b", "--", "::", "k", "end", "(b|c)", "\\e",
         "two\nthree", "straße", "ß", "12", ".", " ", "foo.", "bar.", "", None, "zzz", "cmd", "a  b", "windows"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rows = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "quick")], "id long, body string")
    path = str(tmp_path_factory.mktemp("index"))
    write_term_index(rows, "id", "body", path, bands=7)
    return rows, path


def _terms(spark, terms):
    return spark.createDataFrame([(t,) for t in terms], "term string")


def test_one_term_at_a_time_as_the_literal_test(spark, indexed):
    rows, path = indexed
    # every term with its rows in one go: has_any of one term each
    from huntframe.sources import term_index

    found = term_index._matches(rows, "id", "body", path, _terms(spark, TERMS), "term", 0).distinct().collect()
    got = {}
    for r in found:
        got.setdefault(r.wanted, set()).add(r.id)
    checks = rows.filter("id is not null").select("id", *[has("body", t).alias(f"t{i}") for i, t in enumerate(TERMS) if t]).collect()
    for i, term in enumerate(TERMS):
        if term:
            assert got.get(term.lower(), set()) == {r.id for r in checks if r[f"t{i}"]}, term


def test_any_and_all(spark, indexed):
    rows, path = indexed
    rng = random.Random(1)
    usable = [t for t in TERMS if t is not None]
    for n in (1, 2, 3):
        terms = rng.sample(usable, n)
        table = _terms(spark, [*terms, None])
        some = rows_with_any(rows, "id", "body", path, table)
        assert some.columns == rows.columns
        assert {r.id for r in some.collect()} == {r.id for r in rows.filter(has_any("body", terms)).collect()} - {None}
        every = {r.id for r in rows_with_all(rows, "id", "body", path, table).collect()}
        assert every == {r.id for r in rows.filter(has_all("body", terms)).collect()} - {None}
    assert rows_with_any(rows, "id", "body", path, _terms(spark, [])).collect() == []
    assert rows_with_all(rows, "id", "body", path, _terms(spark, [])).count() == len(TEXTS) + 1


def test_only_bands_of_the_terms_are_read(spark, tmp_path):
    rows = spark.range(4000).select("id", F.concat(F.lit("all w"), (F.col("id") % 1000).cast("string")).alias("body"))
    write_term_index(rows, "id", "body", str(tmp_path), bands=16)
    found = look_up(spark, str(tmp_path), _terms(spark, ["w77"]))
    assert len(found.collect()) == 4
    # one band of the sixteen is read, and in its file only row groups that may hold the term
    assert re.search(r"PartitionFilters: \[(isnotnull\(band#\d+\), )?\(band#\d+ = \d+\)\]", plan_of(found))
    assert spark.read.parquet(f"{tmp_path}/bands").count() == 16
    # a term that every row has is spread over bands, and found in all of them
    assert len(look_up(spark, str(tmp_path), _terms(spark, ["all"])).collect()) == 4000
    assert spark.read.parquet(f"{tmp_path}/terms").filter("term = 'all'").select("band").distinct().count() > 4


def test_a_hundred_thousand_terms(spark, tmp_path):
    rows = spark.range(3000).select("id", F.concat_ws(" ", F.lit("common"), F.concat(F.lit("n"), F.col("id").cast("string"))).alias("body"))
    write_term_index(rows, "id", "body", str(tmp_path), bands=8)
    terms = spark.range(100_000).select(F.concat(F.lit("N"), (F.col("id") * 3).cast("string")).alias("term"))
    found = rows_with_any(rows, "id", "body", str(tmp_path), terms)
    assert {r.id for r in found.collect()} == set(range(0, 3000, 3))


def test_empty_table_and_bad_bands(spark, tmp_path):
    rows = spark.createDataFrame([], "id long, body string")
    write_term_index(rows, "id", "body", str(tmp_path / "a"), bands=2)
    assert rows_with_any(rows, "id", "body", str(tmp_path / "a"), _terms(spark, ["x"])).collect() == []
    with pytest.raises(ValueError):
        write_term_index(rows, "id", "body", str(tmp_path / "b"), bands=5000)


def test_a_text_meets_all_its_open_terms_at_once(spark, tmp_path, monkeypatch):
    from huntframe.sources import term_index

    path, texts = str(tmp_path), ["a b c d", "b c", "c d e", "e f", "x y", "A  B", "b-c"]
    rows = spark.createDataFrame([*enumerate(texts), (1, "b c"), (1, "x b c")], "id long, body string")
    write_term_index(rows, "id", "body", path, bands=3)
    table = _terms(spark, ["a b", "b c", "c d", "d e", "x"])
    met, plain = [], term_index.join

    def seen(left, right, key, kind, **rest):
        met.append((left, right, kind))
        return plain(left, right, key, kind, **rest)

    monkeypatch.setattr(term_index, "join", seen)
    assert sorted((r.id, r.body) for r in rows_with_any(rows, "id", "body", path, table).collect()) == [
        (0, "a b c d"), (1, "b c"), (1, "b c"), (1, "x b c"), (2, "c d e"), (4, "x y")]
    wanted = next(right for left, right, kind in met if "_subject" in left.columns)
    assert sorted(r.id for r in wanted.select("id").collect()) == [0, 2, 3, 5, 6]  # no row twice, and none that has the word x
