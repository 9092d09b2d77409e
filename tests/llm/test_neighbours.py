import numpy as np
import pytest
from pyspark.sql import functions as F

from huntframe.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, id string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "clash")
                                  for i, v in rows], SCHEMA)


def brute(rows, asked, k):
    sound = [(i, np.float32(v).astype(float)) for i, v in rows if i is not None and v and None not in v
             and np.isfinite(np.float32(v)).all() and np.any(np.float32(v))]
    best = {}
    for i, q in sound:
        if asked(i):
            mine = best.setdefault(i, {})
            for j, x in sound:
                if j != i:
                    mine[j] = max(mine.get(j, -np.inf), float((q * x).sum()))
    return {i: [(j, -s) for s, j in sorted((-s, j) for j, s in mine.items())[:k]] for i, mine in best.items()}


def got(df, k, **options):
    rows = neighbours.search(df, F.col("id") % 10 == 0, k=k, **options).orderBy("query_id", "rank").collect()
    out = {}
    for r in rows:
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def clusters(seed, n, dim=16, groups=12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim)) * 2
    return [(i, (centres[i % groups] + 0.5 * rng.standard_normal(dim)).tolist()) for i in range(n)]


def test_all_parts_give_the_exact_answer_in_blocks(spark):
    rows = clusters(1, 400)
    found = got(table(spark, rows), 7, mass=1.1, parts=4, block_rows=30)
    expected = brute(rows, lambda i: i % 10 == 0, 7)
    assert {q: [j for j, _ in v] for q, v in found.items()} == {q: [j for j, _ in v] for q, v in expected.items()}
    for q, pairs in expected.items():
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in pairs], rel=1e-12)


def test_recall_with_routing(spark):
    rows = clusters(2, 3000)
    found, expected = got(table(spark, rows), 10), brute(rows, lambda i: i % 10 == 0, 10)
    shared = [len({j for j, _ in found[q]} & {j for j, _ in v}) / len(v) for q, v in expected.items()]
    assert np.mean(shared) >= 0.9


def test_odd_vectors_ties_and_copies(spark):
    rows = [(0, [1, 0]), (1, [1, 0]), (2, [1, 0]), (10, [0, 1]), (3, None), (4, []), (5, [0, 0]), (6, [1, None]),
            (7, [float("nan"), 1]), (8, [float("inf"), 1]), (9, [1, 2, 3]), (20, [2, 2]), (None, [1, 1])]
    rows += [(100 + i, [3, 1]) for i in range(60)]
    flat = [r for r in rows if r[0] != 9]  # another length takes no part
    assert got(table(spark, rows), 4, mass=1.1) == brute(flat, lambda i: i % 10 == 0, 4)


def test_equal_vectors_of_repeated_ids(spark):
    rows = [(i, [1.0, 2.0]) for i in range(30) for _ in range(2)]
    found = got(table(spark, rows), 20)
    assert found == brute(rows, lambda i: i % 10 == 0, 20) and [j for j, _ in found[0]] == list(range(1, 21))
    rows += [(10, [2.0, 0.0]), (10, [0.0, 1.0]), (3, [5.0, 5.0]), (40, [-1.0, 0.0])]
    assert got(table(spark, rows), 6) == brute(rows, lambda i: i % 10 == 0, 6)


def test_a_query_finds_k_rows_where_its_part_is_small(spark):
    rng = np.random.default_rng(5)
    rows = [(i, ([4.0, 0.0] if i % 50 else [0.0, 4.0]) + 0.1 * rng.standard_normal(2)) for i in range(400)]
    rows = [(i, v.tolist()) for i, v in rows]
    found = got(table(spark, rows), 12, mass=0.0, parts=8)
    assert all(len(v) == 12 for v in found.values())


def recall(found, expected):
    return np.mean([len({j for j, _ in found[q]} & {j for j, _ in v}) / len(v) for q, v in expected.items()])


def test_recall_on_tight_groups_and_on_noise(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((100, 32))
    tight = [(i, (centres[i % 100] + 0.05 * rng.standard_normal(32)).tolist()) for i in range(1500)]
    noise = [(i, rng.standard_normal(32).tolist()) for i in range(1500)]
    for rows in (tight, noise):
        assert recall(got(table(spark, rows), 20, parts=16), brute(rows, lambda i: i % 10 == 0, 20)) >= 0.9


def test_the_measured_recall_sets_what_is_visited(spark):
    x = np.array([v for _, v in clusters(6, 4000, dim=16, groups=64)])
    rows = table(spark, list(enumerate(x.tolist()))).selectExpr("vec_id as id", "embedding as v")
    router = neighbours.fit(rows, 10, parts=32, sample_rows=3000)
    assert router.recall >= neighbours.RECALL and router.visited < 0.5
    assert neighbours.fit(rows, 10).parts == 1 and neighbours.fit(rows, 10, parts=64, sample_rows=500).parts == 8


def test_few_rows_and_empty_table(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0])]
    assert got(table(spark, rows), 20) == brute(rows, lambda i: i % 10 == 0, 20)
    assert got(table(spark, []), 20) == {}


def test_parts_are_balanced_and_keep_neighbours_together():
    x = np.array([v for _, v in clusters(3, 1024, groups=8)])
    graph = neighbours.neighbour_graph(x, 8)
    label = neighbours.balanced_parts(graph, 8, np.random.default_rng(1))
    sizes = np.bincount(label, minlength=8)
    assert sizes.min() >= 120 and sizes.max() <= 136
    assert (label[graph] == label[:, None]).mean() > 0.6
