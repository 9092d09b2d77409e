import random
import re

import pytest

from huntframe.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    windows = {}
    for name, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[k:k + size]), set()).update([str(name)] if name is not None else [])
    out = []
    for name, text in docs:
        words = words_of(text)
        hit, found = [False] * len(words), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                names = windows.get(tuple(words[k:k + size]))
                if names is not None:
                    found |= names
                    hit[k:k + size] = [True] * size
        out.append((name, len(words), sum(hit), sorted(found)))
    return sorted(out, key=str)


def got(spark, documents, docs, items, **options):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.mark(documents(docs), benchmark, **options).collect()
    return sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows], key=str), rows


@pytest.mark.parametrize("part_words", [100_000, 20])
def test_random_words(spark, documents, part_words):
    rng = random.Random(1)
    def text(n):
        return " ".join(rng.choice("ab c d é Ff 1".split(" ")) for _ in range(n))
    items = [(i, text(rng.randint(0, 9))) for i in range(12)] + [(20, None), (None, "a b"), (21, ". , !"), (22, items_copy := "a a b c")]
    items.append((23, items_copy))
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    for window in (3, 5):
        found, _ = got(spark, documents, docs, items, window=window, part_words=part_words)
        assert found == brute(docs, items, window)


def test_odd_rows_and_empty_tables(spark, documents, odd_rows):
    items = [(1, "one two"), (2, "word " * 12)]
    found, rows = got(spark, documents, odd_rows, items)
    assert found == brute(odd_rows, items, 10)
    assert len(rows) == len(odd_rows)
    assert got(spark, documents, [], items)[0] == []
    assert got(spark, documents, odd_rows, [])[0] == brute(odd_rows, [], 10)


def test_spans_are_the_hit_words(spark, documents):
    text = "Intro: é the QUICK brown, fox; end the quick brown fox"
    items = [(1, "the quick brown fox")]
    _, rows = got(spark, documents, [(1, text)], items, window=4)
    raw = text.encode()
    assert [raw[s.start:s.end].decode() for s in rows[0].spans] == ["the QUICK brown, fox", "the quick brown fox"]


def test_remove(spark, documents):
    passage = " ".join(f"w{i}" for i in range(12))
    filler = " ".join(f"é{i}" for i in range(40))
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = documents([(1, filler), (2, f"{filler} {passage} {filler}"), (3, passage), (4, None), (5, ""), (None, filler)])
    rows = {r.doc_id: r.text for r in decontaminate.remove(docs, benchmark).collect()}
    assert rows == {1: filler, 2: f"{filler}  {filler}", 4: None, 5: "", None: filler}
    assert decontaminate.remove(docs, benchmark).columns == docs.columns
