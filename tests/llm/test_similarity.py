import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from huntframe.llm import similarity
from huntframe.llm.components import connected
from plans import plan_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles_of(text, size):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k:k + size]) for k in range(len(words) - size + 1))


def components(vertices, links):
    parent = {v: v for v in vertices}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {v: root(v) for v in vertices}


def brute(rows, size, percent):
    """Every pair compared; rows of one id are one vertex."""
    sets = [(i, shingles_of(t, size)) for i, t in rows]
    links = [(a, b) for a, x in sets for b, y in sets if a is not None and b is not None and a != b and x and y
             and 100 * len(x & y) >= percent * len(x | y)]
    found = components({i for i, _ in rows if i is not None}, links)
    return sorted([(i, len(s), found.get(i)) for i, s in sets], key=str)


def got(docs, size, percent, **options):
    rows = similarity.link(docs, size, percent, **options).collect()
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in rows], key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10_000)}"
    return words


def corpus(seed):
    """Copies, near copies around the threshold, common passages in unlike documents, short documents."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(vocabulary) for _ in range(25)] for _ in range(3)]
    texts = []
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        texts += [edited(rng, base, rng.randint(0, 5)) for _ in range(rng.randint(1, 12))]
    for _ in range(25):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
        texts.append(rng.choice(passages) + own if rng.random() < 0.7 else own)
    texts += [["Same", "few"], ["same", "FEW"], ["same"], [], ["same"]] + [passages[0]] * 5
    rng.shuffle(texts)
    return [(3 * i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,size,percent", [(1, 3, 90), (2, 5, 80), (3, 2, 50)])
def test_random_corpora(documents, seed, size, percent):
    rows = corpus(seed)
    assert got(documents(rows), size, percent, shard_bytes=3000) == brute(rows, size, percent)


def test_large_group_of_near_copies_and_a_common_passage(documents):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join(edited(rng, base, rng.randint(1, 3)))) for i in range(80)]
    rows += [(1000 + i, " ".join(passage + [f"x{rng.randrange(9999)}" for _ in range(20)])) for i in range(80)]
    assert got(documents(rows), 3, 90, shard_bytes=20_000) == brute(rows, 3, 90)


def test_odd_rows_and_empty_table(documents, odd_rows):
    docs = documents(odd_rows).withColumnRenamed("source", "component_id").withColumnRenamed("lang", "shard")
    assert got(docs, 3, 90) == brute(odd_rows, 3, 90)
    assert got(documents([]), 3, 90) == []


def test_prefixes_share_as_many_as_they_ask_for():
    rng = np.random.default_rng(4)
    frequencies = rng.integers(0, 1000, 1 << 10)
    order = similarity.Prefixes(frequencies, 80)
    for _ in range(300):
        base = np.unique(rng.integers(0, 1 << 63, rng.integers(2, 80), dtype=np.uint64))
        other = np.unique(np.concatenate([base[rng.random(len(base)) < 0.93], rng.integers(0, 1 << 63, 2, dtype=np.uint64)]))
        both = len(np.intersect1d(base, other))
        if 100 * both >= 80 * (len(base) + len(other) - both):
            (p, a), (q, b) = order.of(base), order.of(other)
            assert len(np.intersect1d(p, q)) >= min(a, b)


def test_components_of_random_links(spark):
    rng = random.Random(2)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)]
    rows = connected(spark.createDataFrame(links, "a long, b long")).collect()
    vertices = {v for link in links for v in link if link[0] != link[1]}
    assert {r.id: r.component for r in rows} == components(vertices, links)
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_shingles_are_dealt_out_once_for_each_look(spark, documents, monkeypatch):
    stored, plans = similarity._stored, []

    def seen(df, label):
        plans.append(plan_of(df))
        return stored(df, label)

    monkeypatch.setattr(similarity, "_stored", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        common = " ".join(f"c{i}" for i in range(30))
        rows = [(i, f"{common} end{i % 7} and{i % 3}") for i in range(40)]
        found = similarity.link(documents(rows), size=3, percent=80).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.component_id for r in found} == {0}
    looks = [p.split("\n") for p in plans if "Generate inline" in p]
    assert len(looks) == similarity.FIRST_LOOKS + 1
    for lines in looks:
        for at in [i for i, line in enumerate(lines) if "Generate inline" in line]:
            # the nearest exchange that a row of one shingle passes
            above = [line for line in lines[:at] if "Exchange" in line and line.index("Exchange") < lines[at].index("Generate")]
            assert "Exchange hashpartitioning(token" in above[-1]


def test_only_sets_that_pairs_hold_are_moved(spark):
    sets = spark.range(-3000, 3000).select("id", F.array("id").alias("shingles"))
    asked = [(i, i + 17) for i in range(-2990, 2900, 41)]
    pairs = spark.createDataFrame(asked, "a long, b long")
    found = [r.id for r in similarity._asked(sets, pairs).collect()]
    wanted = {x for pair in asked for x in pair}
    assert len(found) == len(set(found)) and wanted <= set(found) and len(found) < len(wanted) + 20
    assert similarity._asked(sets, pairs.limit(0)).count() == 0


def test_marks_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(6)
    for n in (1, 5, 60, 400, 3000):
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for kept in (0.0, 0.5, 0.9, 0.98, 1.0):
            other = np.unique(np.concatenate([base[rng.random(len(base)) < kept], rng.integers(0, 1 << 63, 3, dtype=np.uint64)]))
            differ = similarity.marks_of(base) ^ similarity.marks_of(other)
            assert sum(int(x).bit_count() for x in differ.view(np.uint64)) <= len(np.setxor1d(base, other))


def test_unlike_documents_that_share_many_shingles_are_not_looked_up_by_pairs(documents, monkeypatch):
    verified, asked = similarity._verified, []

    def seen(pairs, sets, percent):
        asked.append(pairs.count())
        return verified(pairs, sets, percent)

    monkeypatch.setattr(similarity, "_verified", seen)
    rng = random.Random(12)
    # every fourth word is one of two: any two documents share a good half of their shingles
    rows = [(i, " ".join(f"w{k}" if k % 4 else f"{rng.choice('ab')}{k}" for k in range(48))) for i in range(120)]
    assert got(documents(rows), 3, 80, shard_bytes=20_000) == brute(rows, 3, 80)
    assert sum(asked) < 3 * len(rows)


def test_a_pair_of_the_last_look_is_made_once(spark):
    marks, lists = [0] * 8, {1: [5, 6, 7, 9], 2: [4, 6, 7, 9], 3: [8, 9]}
    rows = [(i, 100, i, marks, tokens, token, place) for i, tokens in lists.items() for place, token in enumerate(tokens)]
    tokens = spark.createDataFrame(
        rows, "id long, n long, component long, marks array<long>, tokens array<long>, token long, place long")
    found = similarity._unlike_components(tokens, tokens.select("token").distinct(), 90)
    assert sorted(map(tuple, found.collect())) == [(1, 2), (1, 3), (2, 3)]


def test_documents_that_the_bulk_of_a_group_misses(documents):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for place in rng.sample(range(120), rng.choice([0, 1, 1, 2, 3])):
            words[place] = f"x{i}_{place}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(w[k:k + 3]) for k in range(len(w) - 2)} for w in (t.split() for _, t in rows)]
    component = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                low, high = sorted((component[a], component[b]))
                component = [low if c == high else c for c in component]
    found = {r.doc_id: r.component_id for r in similarity.link(documents(rows), size=3, percent=90).collect()}
    assert found == dict(enumerate(component))
