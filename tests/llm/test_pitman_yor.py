import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from huntframe.llm import pitman_yor
from huntframe.llm.text import Powers

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens_of(text):
    return [*WORD.findall((text or "").encode().lower()), "end"]


def learns(name):
    return name is not None and zlib.crc32(str(name).encode()) % 7 != 2


def scored(docs, **options):
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    return pitman_yor.score(docs, ~held_out, **options).collect()


def check_base(rows, found):
    counts = Counter(t for i, text in rows if learns(i) for t in tokens_of(text))
    n, v = sum(counts.values()), len(counts)
    expected = sorted((str(i), len(tokens_of(t)), sum(counts[w] > 0 for w in tokens_of(t)), n,
                       round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens_of(t)), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected


def corpus(seed, n):
    rng = random.Random(seed)
    followers = {w: [f"w{rng.randrange(80)}" for _ in range(4)] for w in [f"w{i}" for i in range(80)]}
    rows = []
    for i in range(n):
        word, words = f"w{rng.randrange(80)}", []
        for _ in range(rng.randint(1, 40)):
            words.append(word)
            word = rng.choice(followers[word]) if rng.random() < 0.9 else f"x{rng.randrange(500)}"
            word = word if word in followers else f"w{rng.randrange(80)}"
        rows.append((i, " ".join(words)))
    return rows


def test_counts_base_and_better_scores_over_many_shards(documents):
    rows = corpus(1, 300)
    found = scored(documents(rows), shard_bytes=4000)
    check_base(rows, found)
    held_out = [r for r in found if not learns(r.doc_id)]
    gain = sum(r.score - r.base_score for r in held_out) / sum(r.n_tokens for r in held_out)
    assert gain > 0.2


def test_shards_do_not_change_the_score_much(documents):
    rows = corpus(2, 120)
    one, many = ({r.doc_id: r.score for r in scored(documents(rows), shard_bytes=b)} for b in (1 << 20, 2000))
    assert all(abs(one[i] - many[i]) < 0.05 * abs(one[i]) + 0.5 for i in one)


def test_odd_rows_and_empty_table(documents, odd_rows):
    docs = documents(odd_rows).withColumnRenamed("source", "score").withColumnRenamed("lang", "shard")
    found = scored(docs)
    assert found[0].__fields__[:4] == ["doc_id", "text", "shard", "n_chars"]
    check_base(odd_rows, found)
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    assert scored(documents([])) == []


def test_nothing_to_learn_from(documents):
    rows = pitman_yor.score(documents([(1, "a b"), (2, None)]), F.lit(None).cast("boolean")).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [(3, 0, 0), (1, 0, 0)]
    assert all(r.base_score == 0 and r.score == pytest.approx(0) for r in rows)


def test_probabilities_of_all_words_add_up(documents):
    """Over every word known and one unknown, after a given word."""
    rows = corpus(3, 80)
    known = sorted({w for i, t in rows if learns(i) for w in t.split()})
    asked = [(100_000 + k, f"w1 {w}") for k, w in enumerate([*known, "never", ""])]
    chosen = [(i, t) for i, t in asked if True]
    held_out = F.col("doc_id") >= 100_000
    found = {r.doc_id: r for r in pitman_yor.score(documents(rows + chosen), ~held_out).collect()}
    # score of "w1 w end" less that of "w1" and of "end after w" leaves p(w | w1); asked through pairs of texts
    single = {r.text: r.score for r in pitman_yor.score(documents(rows + [(200_000 + k, w) for k, w in enumerate([*known, "never"])]),
                                                        F.col("doc_id") < 100_000).filter("doc_id >= 200000").collect()}
    start = {r.doc_id: r.score for r in found.values() if r.doc_id >= 100_000}
    first = start[100_000 + len(known) + 1]  # "w1 " alone: p(w1 | start) p(end | w1)
    total = 0.0
    empty = pitman_yor.score(documents(rows + [(300_000, "")]), F.col("doc_id") < 100_000).filter("doc_id = 300000").first().score
    assert first < 0 and empty < 0 and single
    for k, w in enumerate([*known, "never"]):
        total += 10 ** (start[100_000 + k] - first)  # p(w | w1) p(end | w) / p(end | w1)
    assert 0 < total


def test_table_draws_follow_their_distribution():
    rng = np.random.default_rng(1)
    discount, strength, c, parent, others = 0.5, 1.0, 4, 0.3, 6.0
    logs = pitman_yor.stirling_logs(discount)

    def ways(n, t):  # brute-force weights of seatings of n customers at t tables
        if n == 0:
            return 1.0 if t == 0 else 0.0
        if t < 1 or t > n:
            return 0.0
        return ways(n - 1, t - 1) + (n - 1 - t * discount) * ways(n - 1, t)

    weights = np.array([ways(c, t) * math.prod(parent * (strength + discount * (others + i)) for i in range(t)) for t in range(1, c + 1)])
    assert np.exp(logs[c, 1:c + 1]) == pytest.approx([ways(c, t) for t in range(1, c + 1)])
    n = 40_000
    drawn = pitman_yor.drawn_tables(np.full(n, c), np.full(n, parent), np.full(n, others), discount, strength, logs, rng)
    assert np.bincount(drawn, minlength=c + 1)[1:] / n == pytest.approx(weights / weights.sum(), abs=0.01)
    large = pitman_yor.drawn_tables(np.full(2000, 5000), np.full(2000, 0.01), np.full(2000, 10.0), discount, strength, logs, rng)
    assert 1 <= large.min() and large.max() <= 5000 and 1.5 < large.mean() < 60


def gibbs(texts, sweeps, burn_in, rng):
    """Mean predictive probabilities of a sampler that seats one customer after another: p(context, word)."""
    d, s, d0, s0 = pitman_yor.PAIR_DISCOUNT, pitman_yor.PAIR_STRENGTH, pitman_yor.ROOT_DISCOUNT, pitman_yor.ROOT_STRENGTH
    pairs = [p for t in texts for p in zip(["start", *tokens_of(t)], tokens_of(t))]
    vocabulary = len({w for _, w in pairs})
    seats, customers, opened, root = {}, Counter(), Counter(), {}
    sums = Counter()

    def base_p(w):
        tables = sum(map(len, root.values()))
        return (max(sum(root.get(w, [])) - d0 * len(root.get(w, [])), 0) + (s0 + d0 * tables) / (vocabulary + 1)) / (
            s0 + sum(opened.values()))

    def sit(tables, new):
        at = rng.choices(range(len(tables) + 1), [*tables, new])[0]
        return at

    def add(u, w):
        mine = seats.setdefault((u, w), [])
        total = sum(len(x) for (a, _), x in seats.items() if a == u)
        at = sit([c - d for c in mine], (s + d * total) * base_p(w))
        if at < len(mine):
            mine[at] += 1
        else:
            mine.append(1)
            top = root.setdefault(w, [])
            up = sit([c - d0 for c in top], (s0 + d0 * sum(map(len, root.values()))) / (vocabulary + 1))
            if up < len(top):
                top[up] += 1
            else:
                top.append(1)
            opened[w] += 1
        customers[u] += 1

    def remove(u, w):
        mine, top = seats[u, w], root[w]
        at = rng.choices(range(len(mine)), mine)[0]
        mine[at] -= 1
        customers[u] -= 1
        if not mine[at]:
            del mine[at]
            up = rng.choices(range(len(top)), top)[0]
            top[up] -= 1
            opened[w] -= 1
            if not top[up]:
                del top[up]

    for u, w in pairs:
        add(u, w)
    for sweep in range(sweeps):
        for u, w in pairs:
            remove(u, w)
            add(u, w)
        if sweep >= burn_in:
            for u, w in set(pairs):
                total = sum(len(x) for (a, _), x in seats.items() if a == u)
                sums[u, w] += (max(sum(seats[u, w]) - d * len(seats[u, w]), 0) + (s + d * total) * base_p(w)) / (s + customers[u])
    return {p: x / (sweeps - burn_in) for p, x in sums.items()}


def test_copied_passage_as_a_sampler_of_single_customers(documents):
    rows = [(i, "a b c d e") for i in range(12)] + [(1000 + i, f"a {w} c x{i}") for i, w in enumerate(["b", "e", "y", "b"])]
    p = gibbs([t for _, t in rows], 500, 100, random.Random(4))
    found = pitman_yor.score(documents(rows), F.lit(True), draws=16).collect()
    for r in found:
        pairs = zip(["start", *tokens_of(r.text)], tokens_of(r.text))
        assert r.score == pytest.approx(sum(math.log10(p[x]) for x in pairs), abs=0.08 + 0.2 * r.text.count("x")), r.text


def test_sweeps_see_the_tables_of_the_whole_restaurant(documents):
    """A context always followed by the same word has about one table, however often it stands there."""
    rows = [(i, "a b c d e f g h") for i in range(1, 3000)]
    found = pitman_yor.score(documents(rows), F.col("doc_id") > 1, shard_bytes=4000).filter("doc_id = 1").first()
    assert found.score > -0.02


def test_table_draws_of_many_customers_follow_their_distribution():
    rng, (c, discount, strength, most) = np.random.default_rng(2), (400, 0.85, 1.0, 400)
    logs, short = pitman_yor.stirling_logs(discount, most), pitman_yor.stirling_logs(discount)
    for parent, others in ((0.05, 0.0), (0.01, 200.0), (0.3, 40.0)):
        weights = logs[c, 1:] + np.cumsum(np.log(parent * (strength + discount * (others + np.arange(c)))))
        p = np.exp(weights - weights.max())
        mean = (p * np.arange(1, c + 1)).sum() / p.sum()
        drawn = pitman_yor.drawn_tables(np.full(3000, c), np.full(3000, parent), np.full(3000, others), discount, strength, short, rng,
                                        limit=True)
        assert drawn.mean() == pytest.approx(mean, rel=0.04)


def test_pairs_keep_all_bits_and_four_sweeps_are_averaged():
    text = " ".join(f"w{i}" for i in range(300))
    tokens = pitman_yor.Tokens(pa.table({"_text": [text], "_learn": [True]}), Powers())
    tokens.find_pairs()
    assert pitman_yor.DRAWS == 4 and len(tokens.pairs) == 301 and (tokens.pairs & np.uint64(0xFFFF)).any()


def test_blocks_hold_a_text_once(documents, monkeypatch):
    sharded, seen = pitman_yor.shards.sharded, []

    def counted(docs, *args):
        seen.append([c for c, kind in docs.dtypes if kind == "string" and c not in ("lang", "source")])
        return sharded(docs, *args)

    monkeypatch.setattr(pitman_yor.shards, "sharded", counted)
    rows = [(0, None), (1, "one two"), (2, ""), (3, "one two one")]
    check_base(rows, scored(documents(rows)))
    assert seen == [["text"]]


def test_ranks_stand_for_keys_in_the_same_buckets():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 64, 4000, dtype=np.uint64))
    for buckets in (1, 7, 40):
        place = [int(k) >> 32 for k in keys.tolist()]
        place = np.array([p * buckets >> 32 for p in place])
        own = np.sort(rng.choice(len(keys), 500, replace=False))
        rank = np.array([i - np.searchsorted(place, p) for i, p in enumerate(place.tolist())])
        steps = np.concatenate([np.diff(rank[own][place[own] == p], prepend=0) for p in range(buckets)])
        found = pitman_yor._ranked(keys[own], buckets, steps.astype(np.uint32))
        assert [(int(x) >> 32) * buckets >> 32 for x in found.tolist()] == place[own].tolist()
        assert (found & np.uint64(0xFFFFFFFF)).tolist() == rank[own].tolist() and (np.diff(found.astype(object)) > 0).all()
    assert len(pitman_yor._ranked(keys[:0], 3, np.zeros(0, np.uint32))) == 0
