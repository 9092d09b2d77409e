"""Documents in shards of bounded size, and key look-ups between shards.

A shard is some megabytes of whole documents that one task holds. Shards ask about their different keys: they
send sorted runs of keys to buckets, each a range of the 64-bit keys; a bucket merges the runs of all shards
and answers each of them. A key is sent at most once by a shard, however often it stands there, so no bucket
grows with a frequent key.
"""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntframe.llm.text import SLICE_BYTES, text_slices

SHARD_BYTES = 4 << 20


def shard_count(docs: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES) -> int:
    """How many shards the texts make."""
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    return max(1, -(-total // shard_bytes))


def sharded(docs: DataFrame, shards: int, text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(shard, block): consecutive rows of an input split, up to about ``shard_bytes`` of text, as one compressed
    block; a longer text is a shard of its own. ``shards`` is the number of partitions they are spread over.

    A shard's number comes from its split and its place there, so a repeated task makes the same shards.
    """
    def run(batches):
        first, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
        for part in text_slices(batches, text, min(shard_bytes, SLICE_BYTES)):
            length = pc.sum(pc.binary_length(part.column(text))).as_py() or 0
            if held and size + length > shard_bytes:
                yield _block(first + number, held)
                number, held, size = number + 1, [], 0
            held.append(part)
            size += length
        if held:
            yield _block(first + number, held)

    return docs.mapInArrow(run, "shard long, block binary").repartition(shards, "shard")


def _block(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for part in parts:
            out.write_batch(part)
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                      names=["shard", "block"])


def opened(table: pa.Table) -> pa.Table:
    """The documents of a shard. The tasks of a shard get exactly one block."""
    return pa.ipc.open_stream(table["block"][0].as_buffer()).read_all()


@functools.cache
def _keep_heap() -> None:
    """Large arrays come from the heap and freed ones are used again, not given back and asked for page by page while a group
    is worked on. Set once in each worker."""
    options = getattr(ctypes.CDLL(None), "mallopt", None)
    if options:
        options(-3, 32 << 20)  # M_MMAP_THRESHOLD
        options(-1, 1 << 30)  # M_TRIM_THRESHOLD


def _release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def releasing(work: Callable) -> Callable:
    """A group function that gives freed memory back to the system: workers live on between groups, and
    share an executor's memory with its JVM."""
    def on_one(table: pa.Table) -> pa.Table:
        _keep_heap()
        out = work(table)
        _release()
        return out

    def on_two(left: pa.Table, right: pa.Table) -> pa.Table:
        _keep_heap()
        out = work(left, right)
        _release()
        return out

    return on_one if len(inspect.signature(work).parameters) == 1 else on_two


@functools.cache
def _coders() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """Made once in each worker: runs are many and often short."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(array: np.ndarray | bytes) -> bytes:
    return _coders()[0].compress(array if isinstance(array, bytes) else np.ascontiguousarray(array).tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(_coders()[1].decompress(data), kind)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte of their place value: the high bytes are mostly zero."""
    steps = np.diff(keys, prepend=np.uint64(0)) if len(keys) else keys
    return packed(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def unpacked_keys(data: bytes) -> np.ndarray:
    planes = unpacked(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def by_shard(df: DataFrame, shards: int):
    """Groups rows by shard on the same partitions as ``sharded`` texts, so these are not moved again."""
    return df.repartition(shards, "shard").groupBy("shard")


def runs(shard: int, buckets: int, keys: np.ndarray, **info: np.ndarray) -> pa.Table:
    """Sorted distinct keys of a shard, cut at the borders of the buckets, with arrays of the same length."""
    place = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    cuts = np.searchsorted(place, np.arange(buckets + 1))
    filled = np.flatnonzero(np.diff(cuts))
    columns = {"bucket": pa.array(filled.astype(np.int32)), "shard": pa.array(np.full(len(filled), shard, np.int64))}
    columns["keys"] = pa.array([packed_keys(keys[cuts[b]:cuts[b + 1]]) for b in filled.tolist()], pa.binary())
    for name, values in info.items():
        columns[name] = pa.array([packed(values[cuts[b]:cuts[b + 1]]) for b in filled.tolist()], pa.binary())
    return pa.table(columns)


def answered(asked: DataFrame, kinds: dict[str, np.dtype], merge: Callable) -> DataFrame:
    """(shard, bucket, answer): ``merge(keys, rows, arrays)`` sees a bucket's keys from all its shards.

    ``keys`` are concatenated, ``rows`` gives the run of each, ``arrays`` holds the arrays of ``kinds``; it
    returns an array of one value per key, or several in a dict.
    """
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")  # the answer must not depend on the order of arrival
        lists = {c: [unpacked(x, k) for x in table[c].to_pylist()] for c, k in kinds.items()}
        lists["keys"] = [unpacked_keys(x) for x in table["keys"].to_pylist()]
        sizes = [len(x) for x in lists["keys"]]
        joined = {c: np.concatenate(x) for c, x in lists.items()}
        rows = np.repeat(np.arange(len(sizes)), sizes)
        found = merge(joined.pop("keys"), rows, joined)
        borders = np.concatenate([[0], np.cumsum(sizes)])
        answers = [packed(found[a:b]) for a, b in zip(borders[:-1], borders[1:])]
        return pa.table({"shard": table["shard"], "bucket": table["bucket"], "answer": pa.array(answers, pa.binary())})

    return asked.groupBy("bucket").applyInArrow(releasing(run), "shard long, bucket int, answer binary")


def answers_of(table: pa.Table, kind) -> np.ndarray:
    """All answers to a shard, in the order of the keys it had asked for."""
    if not table.num_rows:
        return np.zeros(0, kind)
    order = np.argsort(table["bucket"].to_numpy())
    data = table["answer"].to_pylist()
    return np.concatenate([unpacked(data[i], kind) for i in order.tolist()])
