import random

import pytest
from pyspark.sql import functions as F

from huntframe.llm import language, sampling, toxicity
from plans import plan_of

WORDS = {"aa": ["der", "und", "nicht", "haus", "straße", "zeit"], "bb": ["the", "and", "house", "street", "time", "not"],
         "cc": ["la", "et", "maison", "été", "rue", "temps"]}


def language_rows(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[lang], k=rng.randint(3, 30))), lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]


def with_lang(spark, rows):
    return spark.createDataFrame([(i, t, lang, "clash", 0) for i, t, lang in rows],
                                 "doc_id long, text string, lang string, score string, n_chars long")


def test_language_of_known_and_unseen_words(spark):
    model = language.fit(with_lang(spark, language_rows(1, 300)))
    unseen = [(1, "häuser straßen nichts", "aa"), (2, "houses streets", "bb"), (3, "maisons étés", "cc")]
    rows = language_rows(2, 200) + unseen
    found = language.predict(with_lang(spark, rows), model).collect()
    assert all(r.lang_pred == r.lang and 0 < r.score <= 1 for r in found)
    assert found[0].__fields__ == ["doc_id", "text", "lang", "n_chars", "lang_pred", "score"]


def plain_language(train, texts):
    """The documented formula with dictionaries, word by word: (language, score) of each text."""
    import math
    import unicodedata
    from collections import Counter

    def words(text):
        out, word = [], ""
        for ch in (text or "") + " ":
            if unicodedata.category(ch)[0] in "LM":
                word += ch.lower() if len(ch.lower()) == 1 else ch
            elif word:
                out.append(word)
                word = ""
        return out

    def grams(word, size):
        padded = f" {word} "
        return [padded[i:i + size] for i in range(len(padded) - size + 1)] if size else [word]

    langs = sorted({lang for _, _, lang in train})
    tables = []
    for size in range(6):
        counts = {lang: Counter(g for _, t, own in train if own == lang for w in words(t) for g in grams(w, size)) for lang in langs}
        keys = set().union(*counts.values())
        total = {lang: sum(counts[lang].values()) + 0.5 * len(keys) for lang in langs}
        tables.append({g: [math.log((counts[lang][g] + 0.5) / total[lang]) for lang in langs] for g in keys})

    def value(word):
        for size in (0, 5, 4, 3, 2, 1):
            hits = [tables[size][g] for g in grams(word, size) if g in tables[size]]
            if hits:
                return [sum(h[k] for h in hits) / len(hits) for k in range(len(langs))]
        return [0.0] * len(langs)

    out = []
    for text in texts:
        found = [value(w) for w in words(text)]
        if not found:
            out.append(("und", 0.0))
            continue
        mean = [sum(v[k] for v in found) / len(found) for k in range(len(langs))]
        belief = [math.exp((m - max(mean)) * min(len(found), 12)) for m in mean]
        best = mean.index(max(mean))
        out.append((langs[best], belief[best] / sum(belief)))
    return out


def test_language_equals_the_plain_formula(spark):
    rng = random.Random(9)
    WORDS["dd"] = ["привет", "ёлка", "дом", "улица", "и"]
    try:
        train, more = language_rows(3, 80), language_rows(4, 40)
    finally:
        del WORDS["dd"]
    letters = "ÉéàßΣςİ漢字дЁéхx–’ 9"
    texts = [t.upper() if i % 2 else t for i, (_, t, _) in enumerate(more)]
    texts += ["".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(40)]
    texts += [None, "", " 12 – ’", "Été été", "ПРИВЕТ—мир", "the–house’s", "x" * 50_000]
    model = language.fit(with_lang(spark, train))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, model).collect()}
    for i, (lang, score) in enumerate(plain_language(train, texts)):
        assert found[i][1] == pytest.approx(score, abs=1e-3), texts[i]
        assert found[i][0] == lang or score < 0.51


def test_language_of_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    model = language.fit(with_lang(spark, language_rows(1, 60) + [(900, None, "dd"), (901, "x", None)]))
    assert model.languages == ["aa", "bb", "cc"]
    for row in language.predict(docs, model).collect():
        letters = any(ch.isalpha() for ch in row.text or "")
        assert (row.lang_pred == "und") == (not letters) and 0 <= row.score <= 1
    assert language.predict(documents([]), model).collect() == []
    nothing = language.fit(documents([]))
    assert nothing is None and {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}


def toxic_rows(seed, n):
    rng = random.Random(seed)
    plain = [f"p{i}" for i in range(400)]
    rows = []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(20, 120))
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "rotten", "nasty"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def labelled(spark, rows):
    return (spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"),
            spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))


def test_toxicity_of_held_out_texts(spark):
    fitted = toxicity.fit(*labelled(spark, toxic_rows(1, 900)))
    held_out = toxic_rows(2, 300)
    found = {r.doc_id: r.score for r in toxicity.score(labelled(spark, held_out)[0], fitted).collect()}
    right = sum((found[i] >= 0.7) == bool(y) for i, _, y in held_out)
    assert right / len(held_out) > 0.97


def test_toxicity_of_odd_rows_and_missing_labels(spark, documents, odd_rows):
    docs, labels = labelled(spark, toxic_rows(1, 300))
    more = spark.createDataFrame([(0, None), (None, 1), (5_000, 1), (1, 0), (1, 1)], "doc_id long, toxic int")
    fitted = toxicity.fit(docs.union(docs.limit(3)), labels.union(more))
    rows = toxicity.score(documents(odd_rows).withColumnRenamed("source", "score"), fitted).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(documents([]), fitted).collect() == []
    only_ordinary = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert {r.score for r in toxicity.score(docs, only_ordinary).collect()} == {0.0}
    none = toxicity.fit(documents([]), labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}


def test_samples_are_bounded_and_without_copies(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("y"),
                                    F.lit(100).cast("long").alias("bytes"))
    drawn = {r.y: r["count"] for r in sampling.bounded_sample(rows, "y", 300, 1 << 30).groupBy("y").count().collect()}
    assert drawn[0] <= 300 and drawn[1] <= 300 and min(drawn.values()) > 200
    small = sampling.bounded_sample(rows, "y", 10_000, 20_000).groupBy("y").count().collect()
    assert all(100 < r["count"] < 300 for r in small)
    words = [" ".join(f"w{i * 50 + j}" for j in range(50)) for i in range(4)]
    texts = [(1, words[0]), (2, words[0]), (3, words[0] + " more"), (4, words[1]), (5, ""), (6, None), (7, words[2])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    kept = {r.doc_id for r in sampling.without_near_copies(sampling.near_copy_marks(docs)).collect()}
    assert {1, 4, 7} <= kept and 2 not in kept and 3 not in kept


def test_a_tie_of_votes_is_toxic(spark):
    docs, labels = labelled(spark, toxic_rows(3, 40))
    voted = labels.withColumn("toxic", F.lit(0)).union(labels.withColumn("toxic", F.lit(1)))
    assert toxicity.fit(docs, voted) == {"rate": 1.0, "model": None}


def test_few_texts_of_a_class_still_make_a_model(spark):
    for n in (16, 60):
        rows = [(i, t, y) for i, (_, t, y) in enumerate([r for r in toxic_rows(5, 400) if r[2]][:n // 2]
                                                        + [r for r in toxic_rows(5, 400) if not r[2]][:n // 2])]
        fitted = toxicity.fit(*labelled(spark, rows))
        assert fitted["model"] is not None
        held_out = toxic_rows(6, 100)
        found = {r.doc_id: r.score for r in toxicity.score(labelled(spark, held_out)[0], fitted).collect()}
        toxic, plain = ([found[i] for i, _, y in held_out if y == k] for k in (1, 0))
        above = sum((a > b) + 0.5 * (a == b) for a in toxic for b in plain) / len(toxic) / len(plain)
        assert above > 0.85 and sum(s >= 0.7 for s in plain) < 0.1 * len(plain)
        assert any(s >= 0.7 for s in toxic)


def test_texts_with_one_common_passage_are_not_near_copies(spark):
    passage = " ".join(f"s{j}" for j in range(20))
    docs = spark.createDataFrame([(i, passage + " " + " ".join(f"w{i}x{j}" for j in range(40))) for i in range(30)],
                                 "doc_id long, text string")
    assert sampling.without_near_copies(sampling.near_copy_marks(docs)).count() > 25


def test_stage_keeps_documents_without_a_model(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark, toxic_rows(7, 30))
    labels.withColumn("toxic", F.lit(1)).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == 30


def test_models_are_fitted_without_the_plans_of_earlier_steps(spark, monkeypatch):
    totals, plans = toxicity._totals, []

    def seen(docs, *args):
        plans.append(plan_of(docs))
        return totals(docs, *args)

    monkeypatch.setattr(toxicity, "_totals", seen)
    for n in (40, 400):
        toxicity.fit(*labelled(spark, toxic_rows(8, n)))
    assert len(plans) > len(toxicity.SPREADS)
    assert [p for p in plans if "parquet" not in p or "Exchange" in p or "InMemoryTableScan" in p] == []
