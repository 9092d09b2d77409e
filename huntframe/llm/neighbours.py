"""Approximate nearest neighbours with learned partitions.

On a bounded sample a neighbour graph is built and cut into parts of equal size that keep neighbours
together; a small softmax classifier learns in which parts a vector's neighbours lie. Every row is then
stored in its most probable part, and a query is compared with all rows of its several most probable parts.
How many these are follows from the recall that sampled rows reach which the classifier has not learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huntframe.llm.share import Shared

SAMPLE_ROWS = 8192
PART_ROWS = 2048  # parts are as many as make about this many rows each, a power of two
LEAST_SAMPLED = 32  # but have this many rows of the sample at least
RECALL = 0.97  # aimed at on the rows held out
HELD_OUT = 512  # rows of the sample, an eighth at most
# A query visits its most probable parts until they hold so much of the probability: the least that reaches the recall.
MASSES = (0.5, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 0.999)
BLOCK_ROWS = 4096  # stored rows, and queries, that meet in one task


def neighbour_graph(x: np.ndarray, k: int, which: np.ndarray | None = None) -> np.ndarray:
    """For each row (or each of ``which``) the k rows with the largest inner product, itself left out."""
    which = np.arange(len(x)) if which is None else which
    k = min(k, len(x) - 1)
    out = np.empty((len(which), k), np.int64)
    for start in range(0, len(which), 512):
        own = which[start:start + 512]
        scores = x[own] @ x.T
        scores[np.arange(len(own)), own] = -np.inf
        out[start:start + 512] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Halves the graph again and again, each time along few edges: a spectral order, cut in the middle,
    then exchanges across the cut that take edges off it."""
    n, k = graph.shape
    a, b = np.repeat(np.arange(n), k), graph.ravel()
    sources, targets = np.concatenate([a, b]), np.concatenate([b, a])
    label = np.zeros(n, np.int64)
    while parts > 1:
        side = np.zeros(n, np.int64)
        inside = label[sources] == label[targets]
        s, t = sources[inside], targets[inside]
        degree = np.maximum(np.bincount(s, minlength=n), 1)
        value = rng.standard_normal(n)
        groups = [np.flatnonzero(label == g) for g in np.unique(label)]
        for _ in range(60):  # power iteration towards the slowest mode of each group
            value = 0.5 * value + 0.5 * np.bincount(s, value[t], minlength=n) / degree
            for g in groups:
                value[g] -= np.average(value[g], weights=degree[g])
                value[g] /= np.linalg.norm(value[g]) + 1e-12
        for g in groups:
            side[g[np.argsort(value[g], kind="stable")[len(g) // 2:]]] = 1
        for _ in range(8):  # exchanges
            across = np.bincount(s, side[s] != side[t], minlength=n)
            gain = 2 * across - np.bincount(s, minlength=n)
            moved = 0
            for g in groups:
                left, right = g[side[g] == 0], g[side[g] == 1]
                left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
                m = min(len(left), len(right))
                swap = np.flatnonzero(gain[left[:m]] + gain[right[:m]] > 0)
                swap = swap[:max(1, len(swap) // 2)] if len(swap) else swap
                side[left[swap]], side[right[swap]] = 1, 0
                moved += len(swap)
            if not moved:
                break
        label = label * 2 + side
        parts //= 2
    return label


class Router:
    """A softmax classifier from a vector's direction to the parts in which its neighbours lie."""

    def __init__(self, x: np.ndarray, near: np.ndarray, label: np.ndarray, parts: int, rng: np.random.Generator,
                 steps: int = 200, rate: float = 0.05):
        """``near`` holds the parts of each row's neighbours, ``label`` its own."""
        self.parts = parts
        self.mass, self.recall, self.visited = 1.1, 1.0, 1.0
        z = self._input(x)
        wanted = np.zeros((len(x), parts))
        np.add.at(wanted, (np.arange(len(x)), label), 1.0)
        for column in near.T:
            np.add.at(wanted, (np.arange(len(x)), column), 1.0)
        wanted /= wanted.sum(axis=1, keepdims=True)
        self.weight = 0.01 * rng.standard_normal((z.shape[1], parts))
        first, second = np.zeros_like(self.weight), np.zeros_like(self.weight)
        for step in range(1, steps + 1):
            slope = z.T @ (self._softmax(z @ self.weight) - wanted) / len(z) + 1e-5 * self.weight
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope ** 2
            self.weight -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)

    @staticmethod
    def _input(x: np.ndarray) -> np.ndarray:
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30) * np.sqrt(x.shape[1])
        return np.concatenate([unit, np.ones((len(x), 1))], axis=1)

    @staticmethod
    def _softmax(logits: np.ndarray) -> np.ndarray:
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def most_probable(self, x: np.ndarray, mass: float, held: np.ndarray | None = None,
                      least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's parts, the most probable first, until they hold ``mass`` of the probability (at
        mass 0 just the first) and, where ``held`` gives the rows of each part, ``least`` rows; and how many
        these are. Ties go to the smaller number."""
        p = self._softmax(self._input(x) @ self.weight)
        order = np.argsort(-p, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
        wanted = before < mass
        wanted[:, 0] = True
        if held is not None:
            wanted |= np.cumsum(held[order], axis=1) - held[order] < least[:, None]
        return order[wanted], wanted.sum(axis=1)

    def measure(self, x: np.ndarray, held_out: np.ndarray, k: int, recall: float) -> None:
        """Sets ``mass`` to the least that reaches ``recall`` of the ``k`` nearest of the held-out rows, or to all
        parts, and ``recall`` to what it reaches. The whole table's nearest are nearer than those of the sample, and
        so more often in the parts visited."""
        near = self.most_probable(x, 0.0)[0][neighbour_graph(x, k, held_out)]
        rows = np.arange(len(held_out))
        for mass in MASSES:
            best, count = self.most_probable(x[held_out], mass)
            visited = np.zeros((len(held_out), self.parts), bool)
            visited[np.repeat(rows, count), best] = True
            self.mass, self.recall = mass, float(visited[rows[:, None], near].mean())
            self.visited = float(visited.mean())
            if self.recall >= recall:
                return
        self.mass, self.recall, self.visited = 1.1, 1.0, 1.0


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, name: str, vector: str) -> DataFrame:
    """(id, v): rows with an id and a vector that is not null, empty, zero, or with a null or non-finite
    component, of the length that most rows have (the smaller one if two are as frequent)."""
    v = F.col(f"`{vector}`").cast("array<double>")
    sound = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{name}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<float>").alias("v")
                          if vectors.schema[vector].dataType.elementType.typeName() == "float" else v.alias("v")).filter(
        F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (length.n if length else 0))


def fit(rows: DataFrame, k: int = 20, sample_rows: int = SAMPLE_ROWS, parts: int | None = None, recall: float = RECALL) -> Router | None:
    """Learns from at most ``sample_rows`` rows, drawn by a hash of their id.

    Without ``parts`` there are as many as make about PART_ROWS rows each, as far as the sample has LEAST_SAMPLED rows for
    each: a larger table asks for a larger ``sample_rows``. One part is an exact search.
    """
    total = rows.count()
    if not total:
        return None
    at = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30))
    drawn = rows.filter(at < int(min(1.0, 1.1 * sample_rows / total) * (1 << 30)) + 1).orderBy(at, "id").limit(sample_rows)
    x = _matrix(drawn.select("v").toArrow().column("v"))
    if not len(x):
        x = _matrix(rows.select("v").limit(1).toArrow().column("v"))
    if parts is None:
        parts = 1 << int(np.log2(max(1, total // PART_ROWS)))
    while parts > 1 and len(x) < LEAST_SAMPLED * parts:
        parts //= 2
    rng = np.random.default_rng(7)
    if parts == 1:
        return Router(x, np.zeros((len(x), 0), np.int64), np.zeros(len(x), np.int64), 1, rng, steps=1)
    graph = neighbour_graph(x, k)
    label = balanced_parts(graph, parts, rng)
    held_out = rng.permutation(len(x))[:min(HELD_OUT, len(x) // 8)]
    learned = np.setdiff1d(np.arange(len(x)), held_out)
    router = Router(x[learned], label[graph[learned]], label[learned], parts, rng)
    router.measure(x, held_out, k, recall)
    return router


def search(vectors: DataFrame, is_query, k: int = 20, name: str = "vec_id", vector: str = "embedding",
           mass: float | None = None, parts: int | None = None, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS,
           recall: float = RECALL) -> DataFrame:
    """The ``k`` rows with the largest inner product found for each query: query_id, rank, vec_id, score.

    ``is_query`` is a condition on ``id``. Rows that ``usable`` leaves out take no part. Rows of one id are one
    candidate, which counts with its best row, and one query, which asks with all its rows; never for itself. Ties go to
    the smaller id. A query visits its most probable parts until they hold ``mass`` of the probability (by default what
    reaches ``recall`` on sampled rows, see ``fit``) and k rows of other ids, or all rows. Of equal vectors only the k + 1 smallest ids are stored, as no other
    can be among the nearest; so a vector that a third of the rows share costs no more than one. Parts and their
    queries are compared in blocks.
    """
    rows = usable(vectors, name, vector)
    router = fit(rows, k, sample_rows, parts, recall)
    if router is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    mass = router.mass if mass is None else mass
    shared = Shared(rows.sparkSession, router)
    kind = rows.schema["v"].dataType.simpleString()

    def assigned(df: DataFrame, upto: float, held: np.ndarray | None = None) -> DataFrame:
        def run(batches):
            known = shared.value
            for batch in batches:
                if batch.num_rows:
                    least = None if held is None else batch.column("own").to_numpy() + k
                    best, count = known.most_probable(_matrix(batch.column("v")), upto, held, least)
                    border = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id"), batch.column("v"), pa.ListArray.from_arrays(border, best.astype(np.int32))], names=["id", "v", "part"])

        return df.mapInArrow(run, f"id long, v {kind}, part array<int>").withColumn("part", F.explode("part"))

    # One row for equal rows of one id; then the smallest ids of each vector.
    digest = [F.xxhash64("v").alias("_h"), F.xxhash64("v", F.lit("again")).alias("_g")]
    different = rows.groupBy("id", *digest).agg(F.first("v").alias("v"))
    same = Window.partitionBy("_h", "_g").orderBy("id")
    stored = different.withColumn("_copy", F.row_number().over(same)).filter(F.col("_copy") <= k + 1).select("id", "v")
    queries = different.filter(is_query)
    own = queries.groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    stored = assigned(stored, 0.0)

    def by_part(df: DataFrame) -> dict[int, int]:  # one row per part
        return {r.part: r["count"] for r in df.groupBy("part").count().collect()}

    held = by_part(stored)
    asked = assigned(queries.join(own, "id").select("id", "v", "own"), mass, np.array([held.get(p, 0) for p in range(router.parts)]))
    wanted = by_part(asked)
    # How many blocks each part has on either side.
    blocks = {p: (max(1, -(-held.get(p, 0) // block_rows)), max(1, -(-wanted.get(p, 0) // block_rows))) for p in range(router.parts)}
    ways = [F.create_map(*[F.lit(x) for p, b in sorted(blocks.items()) for x in (p, b[i])])[F.col("part")] for i in (0, 1)]

    def spread(df: DataFrame, own: int) -> DataFrame:
        block = F.pmod(F.xxhash64("id", "v", F.lit("block")), ways[own]).cast("int")
        copies = F.explode(F.sequence(F.lit(0), ways[1 - own] - 1))
        mine, other = ("block", "query_block") if own == 0 else ("query_block", "block")
        return df.withColumn(mine, block).withColumn(other, copies)

    def compare(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        found = {"query_id": [], "vec_id": [], "score": []}
        if candidates.num_rows and queries.num_rows:
            ids, x = candidates["id"].to_numpy(), _matrix(candidates["v"])
            names, q = queries["id"].to_numpy(), _matrix(queries["v"])
            repeated = len(np.unique(ids)) < len(ids)
            for start in range(0, len(q), 256):
                rough = q[start:start + 256] @ x.T
                for row, scores in enumerate(rough, start):
                    scores[ids == names[row]] = -np.inf
                    keep = np.flatnonzero(np.isfinite(scores))
                    if len(keep) > k and not repeated:
                        least = np.partition(scores, -k)[-k]
                        keep = np.flatnonzero(scores >= least - 1e-9 * max(1.0, abs(least)))
                    # Summed in one fixed order, so that equal vectors tie.
                    exact = (q[row] * x[keep]).sum(axis=1)
                    best = np.lexsort((ids[keep], -exact))
                    if repeated:  # each id's best row
                        best = best[np.sort(np.unique(ids[keep][best], return_index=True)[1])]
                    best = best[:k]
                    found["query_id"].append(np.full(len(best), names[row]))
                    found["vec_id"].append(ids[keep][best])
                    found["score"].append(exact[best])
        return pa.table({c: pa.array(np.concatenate(v) if v else [], pa.float64() if c == "score" else pa.int64())
                         for c, v in found.items()})

    keys = ["part", "block", "query_block"]
    near = spread(stored, 0).groupBy(*keys).cogroup(spread(asked, 1).groupBy(*keys)).applyInArrow(
        compare, "query_id long, vec_id long, score double")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return near.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
