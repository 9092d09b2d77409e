from fractions import Fraction

import numpy as np
import pytest

from huntframe.llm import queries, whitening

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(rows, components=8):
    """By numpy's eigenvectors of the whole covariance, and whole numbers."""
    kept = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in kept], object)
    n, sums = len(x), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    centred = np.array([[float(Fraction(int(a) * n - int(s), n)) for a, s in zip(r, sums)] for r in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return [i for i, _ in kept], deviation.tolist(), values, vectors, centred


def compare(got, rows, components=8, each=1e-8):
    ids, deviation, values, vectors, centred = brute(rows, components)
    k = len(values)
    total = float((centred ** 2).sum() / len(ids))
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert len(got) == len(ids) * k
    white = np.array([[by_id[i][c + 1][0].whitened for c in range(k)] for i in ids])
    want = centred @ vectors / np.sqrt(values)
    sign = np.sign((white * want).sum(axis=0))
    assert np.abs(white * sign - want).max() < each
    for i, d in zip(ids, deviation):
        assert {r.deviation for c in by_id[i].values() for r in c} == {d}
    assert {r.n for r in got} == {len(ids)}
    for c in range(k):
        shares = {r.explained for r in got if r.component == c + 1}
        assert len(shares) == 1 and shares.pop() == pytest.approx(values[c] / total, rel=1e-10)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


@pytest.mark.parametrize("spectrum", ["falling", "close", "groups", "wide"])
def test_eigenpairs(spectrum):
    rng = np.random.default_rng(3)
    dims = 400 if spectrum == "wide" else 120
    values = {"falling": 0.9 ** np.arange(dims), "close": np.concatenate([1 + 1e-6 * np.arange(10), rng.random(dims - 10) * 0.99]),
              "groups": np.repeat([5.0, 3.0, 1.0], dims // 3), "wide": np.linspace(1, 2, dims)}[spectrum] * 1e4
    turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    matrix = (turn * values) @ turn.T
    found = whitening.jacobi_davidson(lambda u: matrix @ u, dims, 8)
    top = np.sort(values)[::-1]
    assert np.abs(found.values - top[:8]).max() < 1e-12 * top[0]
    assert found.residuals.max() < 1e-11 * top[0]
    assert np.abs(found.vectors.T @ found.vectors - np.eye(8)).max() < 1e-13
    assert found.products < 60 * 9


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(0)
    turn = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    matrix = (turn * np.concatenate([-np.arange(1, 11), np.arange(1, 21)])) @ turn.T
    right = rng.standard_normal((30, 3))
    right[:, 1] = 0
    shifts = np.array([0.0, 0.3, 0.5])
    got = whitening.minres(lambda v, which: matrix @ v - shifts[which] * v, right, 60, 1e-13)
    for j in range(3):
        assert np.linalg.norm(matrix @ got[:, j] - shifts[j] * got[:, j] - right[:, j]) < 1e-9


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    mixed = rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12)) / 5
    rows = [(i, v.tolist()) for i, v in enumerate(mixed)]
    rows += [(900, None), (901, []), (902, [None] * 12), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11),
             (905, [1.0] * 11 + [None])]
    frame = table(spark, rows).selectExpr("*", "1 AS n", "2 AS component", "3 AS dims").repartition(5)
    result = whitening.whiten(frame)
    assert result.columns == COLUMNS
    compare(result.collect(), rows)


def test_fewer_dimensions_and_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 200)
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((200, 3)))]
    plain = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))
    try:
        compare(whitening.whiten(table(spark, rows).repartition(7)).collect(), rows)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", plain)


def test_without_variance(spark):
    same = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(same) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(3, 0, None, None, None)}
    # variance in one direction only
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 0.5]) for i in range(5)])).collect()
    first = [r for r in line if r.component == 1]
    assert first[0].explained == pytest.approx(1) and first[0].identity_error < 1e-12
    assert all(r.whitened is None for r in line if r.component > 1)
    assert sorted(abs(r.whitened) for r in first)[-1] == pytest.approx(2 ** 0.5)
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None)])).collect() == []


def test_odd_lengths_and_large_entries(spark):
    rows = [(i, [float(i % 4), float(i % 3)]) for i in range(12)]
    compare(whitening.whiten(table(spark, rows + [(20, [1.0]), (21, [1.0] * 3)])).collect(), rows)
    large = whitening.whiten(table(spark, [(0, [3e38, 0.0]), (1, [-3e38, 1.0]), (2, [0.0, 2.0])])).collect()
    assert sorted((r.vec_id, r.deviation) for r in large if r.component == 1) == [(0, None), (1, None), (2, 3072 ** 2)]
    assert whitening._deviations(np.array([[1 << 40]]), np.array([3]), [1], 2) == [None]
    assert whitening._deviations(np.array([[1 << 30, 5]]), np.array([3, 0]), [1, 0], 2) == [(2 * ((1 << 30) - 3) - 1) ** 2 + 100]


def test_query(spark, folder):
    import duckdb

    rows = duckdb.connect().sql(f"select vec_id, embedding from '{folder}/embeddings.parquet'").fetchall()
    compare(queries.op13_whitening(spark, folder).collect(), rows)
