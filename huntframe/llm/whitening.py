"""Whitening of vectors: leading eigenpairs of their covariance by Jacobi-Davidson, without forming the covariance.

The covariance is only ever applied to a few directions: one pass of Spark over stored blocks of vectors gives
``sum of centred * (centred * direction)`` for all directions at once. The driver holds the search space, a handful of
vectors of one entry per dimension. Each round takes the Ritz pairs of the search space, locks those whose residual has
reached double precision, and adds for each other wanted pair a correction, the solution of the projected equation
by some steps of MINRES; the steps of all pairs share their passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntframe.session import scratch_path

SCALE, SHIFT = 1024, 100_000
LARGEST = 1 << 52  # scaled entries beyond are set to it, so that they are whole numbers in double precision

BLOCK_BYTES = 4 << 20
FAN = 64  # partial sums that meet on the driver; more are summed by tasks first

GUARDS = 4  # Ritz pairs kept beyond the wanted ones
SPACES = 6  # search space in multiples of the wanted and guarded pairs
INNER = 4  # steps of MINRES in a round
ROUNDS = 100
#: A residual counts as double precision from this multiple of rounding of the largest eigenvalue on.
PRECISION = 64 * np.finfo(float).eps
#: Where rounding keeps a residual from falling further, it must at least be this small.
STALLED, PATIENCE = 1e-11, 3
#: A component of less than this share of the variance has none but rounding.
NOTHING = 1e-13


def _valid(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries as doubles, where each row begins (one more for the end), and which rows have no null, infinite or
    undefined entry, and one entry at least."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    borders = np.asarray(column.offsets, np.int64)
    entries = column.values
    usable = np.asarray(entries.is_valid())
    values = entries.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64)
    odd = np.concatenate([[0], np.cumsum(~(usable & np.isfinite(values)))])
    good = np.asarray(column.is_valid()) & (odd[borders[1:]] == odd[borders[:-1]]) & (borders[1:] > borders[:-1])
    return values, borders, good


def _packed(batches, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Blocks of scaled vectors of one length, with their ids."""
    for batch in batches:
        values, borders, good = _valid(batch.column("vector"))
        sizes = np.diff(borders)
        ids = batch.column("id")
        for dims in np.unique(sizes[good]).tolist():
            rows = np.flatnonzero(good & (sizes == dims))
            together = max(1, block_bytes // (8 * dims))
            for i in range(0, len(rows), together):
                part = rows[i:i + together]
                taken = values[(borders[part][:, None] + np.arange(dims)).ravel()]
                with np.errstate(over="ignore"):
                    whole = np.clip(np.floor(SCALE * taken), -LARGEST, LARGEST).astype("<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dims], pa.int32()), pa.array([len(part)], pa.int64()),
                     pa.array([ids.take(pa.array(part)).to_pylist()], pa.list_(ids.type)),
                     pa.array([whole.tobytes()], pa.binary())], names=["dims", "n", "ids", "vectors"])


def _blocks(batches) -> Iterator[tuple[list, np.ndarray]]:
    for batch in batches:
        for dims, ids, packed in zip(batch.column("dims").to_pylist(), batch.column("ids"), batch.column("vectors").to_pylist()):
            yield ids, np.frombuffer(packed, "<i8").reshape(-1, dims)


@dataclass
class Vectors:
    """Stored blocks of the vectors of one length, their number and exact sums per dimension."""

    table: DataFrame
    n: int
    dims: int
    sums: list[int]  # of the scaled entries, before the shift

    def __post_init__(self):
        self.partitions = max(1, self.table.rdd.getNumPartitions())
        whole = [s // self.n for s in self.sums]
        self.floor = np.array(whole, np.int64)  # the mean's whole part
        self.rest = [s - self.n * w for s, w in zip(self.sums, whole)]  # the mean's fraction, in n-ths

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        """Centred entries of a block: whole numbers are subtracted first, so nothing is lost to rounding."""
        floor, fraction = self.floor, np.array([r / self.n for r in self.rest])
        return lambda block: (block - floor).astype(np.float64) - fraction

    def summed(self, work: Callable[[np.ndarray], np.ndarray], cells: int) -> np.ndarray:
        """The sum over all blocks of an array with ``cells`` entries, made from each centred block."""
        centre = self.centre()

        def total(batches):
            out = np.zeros(cells)
            for _, block in _blocks(batches):
                out += work(centre(block))
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["part"])

        def again(batches):
            out = np.zeros(cells)
            for batch in batches:
                for part in batch.column("part").to_pylist():
                    out += np.frombuffer(part)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["part"])

        parts, left = self.table.select("dims", "ids", "vectors").mapInArrow(total, "part binary"), self.partitions
        while left > FAN:
            left = -(-left // FAN)
            parts = parts.repartition(left).mapInArrow(again, "part binary")
        return sum((np.frombuffer(r.part) for r in parts.collect()), np.zeros(cells))

    def covariance_times(self, directions: np.ndarray) -> np.ndarray:
        """The covariance (divisor n) applied to each column."""
        shape = directions.shape
        out = self.summed(lambda z: (z.T @ (z @ directions)).ravel(), shape[0] * shape[1])
        return out.reshape(shape) / self.n

    def variance(self) -> float:
        return float(self.summed(lambda z: np.array([np.einsum("ij,ij->", z, z)]), 1)[0]) / self.n


def store(vectors: DataFrame, vector: str = "embedding", name: str = "vec_id") -> Vectors | None:
    """Scaled vectors in the shared folder; None where there are none. Vectors that are null, empty, or hold null or
    non-finite entries are left out, and so are those of another length than the commonest (of equally common ones the
    longest)."""
    spark = vectors.sparkSession
    source = vectors.select(F.col(f"`{name}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    schema = T.StructType([T.StructField("dims", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("ids", T.ArrayType(source.schema["id"].dataType)), T.StructField("vectors", T.BinaryType())])
    size = BLOCK_BYTES
    path = scratch_path(spark, "vectors")
    source.mapInArrow(lambda batches: _packed(batches, size), schema).write.parquet(path)
    table = spark.read.parquet(path)
    lengths = table.groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if lengths is None:
        return None
    table = table.filter(F.col("dims") == lengths.dims)

    def sums(batches):
        total = None
        for _, block in _blocks(batches):
            high, low = (block >> 26).sum(axis=0), (block & ((1 << 26) - 1)).sum(axis=0)
            part = high.astype(object) * (1 << 26) + low.astype(object)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()),
                                              pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], names=["i", "s"])

    found = table.select("dims", "ids", "vectors").mapInArrow(sums, "i int, s decimal(38,0)").groupBy("i").agg(
        F.sum("s").alias("s")).orderBy("i").collect()
    return Vectors(table, lengths.n, lengths.dims, [int(r.s) for r in found])


def _against(basis: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Unit vectors that span what the columns of ``new`` add to an orthonormal basis."""
    out = np.zeros((len(new), 0))
    for column in new.T:
        size = np.linalg.norm(column)
        if not size:
            continue
        column = column / size
        for _ in range(3):  # once more than "twice is enough": the second may leave a tiny rest
            for known in (basis, out):
                column = column - known @ (known.T @ column)
            left = np.linalg.norm(column)
            if left < 1e-10:
                break
            column = column / left
        else:
            out = np.column_stack([out, column])
    return out


def minres(apply: Callable[[np.ndarray, np.ndarray], np.ndarray], right: np.ndarray, steps: int, least: float) -> np.ndarray:
    """Approximate solutions of symmetric systems, one per column, in common steps.

    ``apply(directions, which)`` applies the operators of the columns ``which``. A column rests once its residual is
    ``least`` times its right side.
    """
    size = np.linalg.norm(right, axis=0)
    solution = np.zeros_like(right)
    which = np.flatnonzero(size > 0)
    v = right[:, which] / size[which]
    before, w, w_before = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    beta, eta = np.zeros(len(which)), size[which].copy()
    c, c_before, s, s_before = np.ones(len(which)), np.ones(len(which)), np.zeros(len(which)), np.zeros(len(which))
    for _ in range(steps):
        if not len(which):
            break
        product = apply(v, which)
        alpha = np.einsum("ij,ij->j", v, product)
        after = product - alpha * v - beta * before
        beta_after = np.linalg.norm(after, axis=0)
        first = c * alpha - c_before * s * beta
        root = np.hypot(first, beta_after)
        second, third = s * alpha + c_before * c * beta, s_before * beta
        fine = root > 0
        root = np.where(fine, root, 1.0)
        w, w_before = (v - third * w_before - second * w) / root, w
        c, c_before, s, s_before = first / root, c, beta_after / root, s
        solution[:, which] += np.where(fine, c * eta, 0.0) * w
        eta = -s * eta
        going = fine & (np.abs(eta) > least * size[which]) & (beta_after > 1e-14 * np.abs(alpha))
        v, before = after / np.where(beta_after > 0, beta_after, 1.0), v
        which, v, before, w, w_before = which[going], v[:, going], before[:, going], w[:, going], w_before[:, going]
        beta, eta = beta_after[going], eta[going]
        c, c_before, s, s_before = c[going], c_before[going], s[going], s_before[going]
    return solution


@dataclass
class Eigenpairs:
    values: np.ndarray  # falling
    vectors: np.ndarray  # in columns
    residuals: np.ndarray
    products: int  # passes over the data


def jacobi_davidson(times: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, seed: int = 7) -> Eigenpairs:
    """The ``wanted`` largest eigenpairs of a symmetric matrix of which only products are known."""
    products = 0

    def product(directions: np.ndarray) -> np.ndarray:
        nonlocal products
        products += 1
        return times(directions)

    wanted = min(wanted, dims)
    width = min(dims, wanted + GUARDS)
    most = min(dims, SPACES * width)
    locked, locked_values = np.zeros((dims, 0)), []
    space = _against(locked, np.random.default_rng(seed).standard_normal((dims, width)))
    image = product(space)
    best, stalled, round_ = np.inf, 0, 0
    while True:
        values, turn = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        top = max([abs(v) for v in [*locked_values, *values[:1]]], default=0.0)
        residual = image - space * values
        size = np.linalg.norm(residual - locked @ (locked.T @ residual), axis=0)
        left = min(wanted - len(locked_values), space.shape[1])
        round_ += 1
        exhausted = space.shape[1] + locked.shape[1] >= dims
        stalled = 0 if size[:left].max(initial=0) < best / 2 else stalled + 1
        best = min(best, size[:left].max(initial=np.inf))
        settled = stalled >= PATIENCE and best <= STALLED * top
        # the largest first: a pair is locked only when all larger ones are
        done = 0
        while done < left and (size[done] <= PRECISION * top or settled or exhausted and round_ > 1 and size[done] <= STALLED * top):
            done += 1
        if done:
            locked = np.column_stack([locked, space[:, :done]])
            locked_values += values[:done].tolist()
            space, image, residual, size, values = space[:, done:], image[:, done:], residual[:, done:], size[done:], values[done:]
            best, stalled = np.inf, 0
        left -= done
        if len(locked_values) == wanted:
            break
        if round_ > ROUNDS:
            raise RuntimeError(f"no {wanted} eigenpairs in {ROUNDS} rounds: residuals {size[:left]}")
        open_ = [j for j in range(left) if size[j] > PRECISION * top]
        if space.shape[1] + len(open_) > most:
            space, image = space[:, :2 * width], image[:, :2 * width]
        near = np.column_stack([locked, space[:, :min(space.shape[1], left + GUARDS)]])
        shifts = values[open_]

        def projected(x: np.ndarray) -> np.ndarray:
            return x - near @ (near.T @ x)

        def operator(directions: np.ndarray, which: np.ndarray) -> np.ndarray:
            return projected(product(projected(directions))) - shifts[which] * directions

        corrections = minres(operator, -projected(residual[:, open_]), INNER, 0.5 ** (2 * round_))
        new = _against(np.column_stack([locked, space]), np.column_stack([corrections, residual[:, open_]])[:, :2 * len(open_)]
                       if not exhausted else np.zeros((dims, 0)))[:, :max(1, len(open_))]
        if new.shape[1]:
            space, image = np.column_stack([space, new]), np.column_stack([image, product(new)])
        else:  # nothing new: the products themselves may have gathered rounding
            space = _against(locked, space)
            image = product(space)
    order = np.argsort(-np.array(locked_values), kind="stable")
    vectors = locked[:, order]
    image = product(vectors)
    values = np.einsum("ij,ij->j", vectors, image)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(wanted)] < 0, -1.0, 1.0)
    return Eigenpairs(values, vectors, np.linalg.norm(image - locked[:, order] * values, axis=0), products)


def whiten(vectors: DataFrame, components: int = 8, vector: str = "embedding", name: str = "vec_id") -> DataFrame:
    """Each vector on the leading ``components`` principal directions, scaled to unit variance.

    An entry c counts as floor(1024 * c) + 100000. Vectors that are null, empty, or hold null or non-finite entries are
    left out, and so are vectors of another length than the commonest; entries beyond 2^42 in size count as that.
    Repeated rows and ids, also null ones, stay as they are. Other columns play no part.

    Returns per vector and component (from 1; fewer where there are fewer dimensions) the id, ``n`` (vectors),
    ``deviation`` (sum over dimensions of (n * x - S)^2, exact; null beyond 64 bits), ``whitened``, ``explained`` (share
    of the variance) and ``identity_error`` (largest entry of the whitened vectors' covariance less the identity). A
    component without variance has null in ``whitened`` and plays no part in ``identity_error``; without any variance
    ``explained`` is null as well. No vectors, or an empty table, give no rows.
    """
    spark = vectors.sparkSession
    stored = store(vectors, vector, name)
    schema = T.StructType([
        T.StructField(name, vectors.schema[name].dataType), *T._parse_datatype_string(
            "component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
    if stored is None:
        return _nothing(spark, schema)
    variance = stored.variance()
    if variance > 0:
        pairs = jacobi_davidson(stored.covariance_times, stored.dims, components)
        explained = pairs.values / variance
        some = explained > NOTHING
        onto = np.where(some, pairs.vectors / np.sqrt(np.where(some, pairs.values, 1.0)), np.nan)
        error = _identity_error(stored, onto[:, some])
    else:
        onto = np.full((stored.dims, min(components, stored.dims)), np.nan)
        explained, error = np.full(onto.shape[1], np.nan), None
    return _projected(stored, onto, explained, error, schema)


def _nothing(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def _identity_error(stored: Vectors, onto: np.ndarray) -> float | None:
    k = onto.shape[1]
    if not k:
        return None

    def moments(z: np.ndarray) -> np.ndarray:
        white = z @ onto
        return np.concatenate([(white.T @ white).ravel(), white.sum(axis=0)])

    found = stored.summed(moments, k * k + k) / stored.n
    mean = found[k * k:]
    return float(np.abs(found[:k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(block: np.ndarray, floor: np.ndarray, rest: list[int], n: int) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, where S = n * floor + rest: whole numbers of any size."""
    z = block - floor
    largest = int(np.abs(z).max(initial=0))
    small = (largest + 1) ** 2 * z.shape[1] < 1 << 62 and (largest + 1) * max(1, *rest) * z.shape[1] < 1 << 62
    z = z if small else z.astype(object)
    squares = (z * z).sum(axis=1).tolist()
    mixed = (z * np.array(rest, np.int64 if small else object)).sum(axis=1).tolist()
    own = sum(r * r for r in rest)
    found = [n * n * a - 2 * n * b + own for a, b in zip(squares, mixed)]
    return [f if f < 1 << 63 else None for f in found]


def _projected(stored: Vectors, onto: np.ndarray, explained: np.ndarray, error: float | None, schema: T.StructType) -> DataFrame:
    k, n, floor, rest, centre = onto.shape[1], stored.n, stored.floor, stored.rest, stored.centre()
    names = schema.fieldNames()

    def rows(batches):
        for ids, block in _blocks(batches):
            white = np.nan_to_num(centre(block) @ np.nan_to_num(onto))
            count = len(block)
            lost = np.tile(np.isnan(onto).any(axis=0), count)
            deviation = pa.array(_deviations(block, floor, rest, n), pa.int64())
            each = pa.array(np.repeat(np.arange(count), k))
            shares = np.tile(explained, count)
            yield pa.RecordBatch.from_arrays(
                [ids.values.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                 pa.array(np.full(count * k, n)), deviation.take(each), pa.array(white.ravel(), mask=lost),
                 pa.array(shares, mask=np.isnan(shares)), pa.array([error] * (count * k), pa.float64())], names=names)

    return stored.table.select("dims", "ids", "vectors").mapInArrow(rows, schema)
