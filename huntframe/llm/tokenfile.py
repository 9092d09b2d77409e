"""Token files: every document an independent zstandard frame, a seek table with checksums at the end.

Layout of a file, which as a whole is a valid zstandard stream:

* a frame per document with its ids as little-endian unsigned 32-bit integers,
* a skippable frame with the documents' ids (``DIRECTORY``),
* a skippable frame with the seek table: per frame its compressed size, its size and the lower half of the
  XXH64 of its content, then the number of frames, a flag byte and a closing mark, as in the public
  seekable format,
* a skippable frame of one byte, the line end that Spark's text writer puts after each record.

Spark's own writer stores the files, so they may lie in any store it can reach, and a task that runs twice
leaves one copy.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huntframe.llm.text import Remembered, text_slices

PARTITION_BYTES = 16 << 20  # text that one task encodes
FILE_BYTES = 8 << 20  # compressed size at which a file is closed
KEPT_CHUNKS = 200_000  # of each of the two generations of chunks that a task remembers
KEPT_LENGTH = 64
MARKS = ".,;:!?"
MOST_FILES_SENT = 1_000_000  # up to so many files their places are sent to all tasks (some 50 bytes each)

# Fixed values of the file format.
SKIPPABLE, SEEKABLE, LINE_END = 0x184D2A50, 0x184D2A5E, 0x184D2A53
CLOSING_MARK = 0x8F92EAB1
HAS_CHECKSUMS = 0x80


class Writer:
    """Gathers the documents of one file."""

    def __init__(self, partition: int, number: int):
        self.partition, self.number, self.size = partition, number, 0
        self.frames, self.table, self.names = [], [], []
        self.compressor = zstandard.ZstdCompressor(level=1, write_content_size=True)

    def add(self, name: int | None, ids: bytes) -> None:
        frame = self.compressor.compress(ids)
        self.frames.append(frame)
        self.names.append(name)
        self.table.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.size += len(frame)

    def content(self) -> bytes:
        """The whole file but for its last byte, the line end."""
        n = len(self.frames)
        names = np.array([x or 0 for x in self.names], "<i8").tobytes()
        named = np.array([x is not None for x in self.names], np.uint8).tobytes()
        directory = struct.pack("<qqI", self.partition, self.number, n) + names + named
        table = np.array(self.table, "<u4").tobytes() + struct.pack("<IBI", n, HAS_CHECKSUMS, CLOSING_MARK)
        return b"".join([*self.frames, struct.pack("<II", SKIPPABLE, len(directory)), directory,
                         struct.pack("<II", SEEKABLE, len(table)), table, struct.pack("<II", LINE_END, 1)])


class Reader:
    """A file's documents; only those asked for are decompressed."""

    def __init__(self, content: bytes):
        self.content = memoryview(content)
        end = len(content) - 9
        n, flags, mark = struct.unpack_from("<IBI", content, end - 9)
        if mark != CLOSING_MARK or flags != HAS_CHECKSUMS:
            raise ValueError("no seek table at the end")
        at = end - 9 - 12 * n
        kind, size = struct.unpack_from("<II", content, at - 8)
        if kind != SEEKABLE or size != 12 * n + 9:
            raise ValueError("the seek table has another size than its frame")
        self.table = np.frombuffer(content, "<u4", 3 * n, at).reshape(n, 3).astype(np.int64)
        at = int(self.table[:, 0].sum())
        kind, size = struct.unpack_from("<II", content, at)
        if kind != SKIPPABLE:
            raise ValueError("no directory after the frames")
        self.partition, self.number, _ = struct.unpack_from("<qqI", content, at + 8)
        names = np.frombuffer(content, "<i8", n, at + 28)
        named = np.frombuffer(content, np.uint8, n, at + 28 + 8 * n)
        self.names = [x if known else None for x, known in zip(names.tolist(), named.tolist())]
        self.places = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.tokens = self.table[:, 1] // 4

    def document(self, i: int) -> bytes:
        """The ids of the i-th document; raises if the frame is damaged."""
        frame = self.content[self.places[i]:self.places[i + 1]]
        ids = zstandard.ZstdDecompressor().decompress(frame)
        if len(ids) != self.table[i, 1] or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self.table[i, 2]:
            raise ValueError(f"frame {i} does not match its checksum")
        return ids


def word_encoder(tokenizer: str) -> Callable[[list[str]], list[bytes]]:
    """Encodes texts with the tokenizers library, each different chunk once.

    For a tokenizer that drops white space, as the ids of a text are then those of its chunks in a row. If it
    also makes letters small and parts them from a mark that follows, "Word" and "word," need no look at their own.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(tokenizer)
    library.no_truncation()
    library.no_padding()
    suffix = getattr(library.model, "end_of_word_suffix", None)
    last = np.zeros(library.get_vocab_size(), bool)
    for token, number in library.get_vocab().items() if suffix else ():
        last[number] = token.endswith(suffix)

    def same(a: str, b: str) -> bool:
        return library.encode(a, add_special_tokens=False).ids == library.encode(b, add_special_tokens=False).ids

    parts_marks = all(same(f"{x}{m}", f"{x.lower()} {m}") for x in ("Word", "LL", "t", "No") for m in MARKS)
    known = Remembered()

    def looked_up(chunks: list[str]) -> dict[str, bytes]:
        # Plain words are pieces, whose last tokens show where each ends: many of them go into one call.
        words = [c for c in chunks if suffix and parts_marks and c.isascii() and c.isalpha()]
        found = {}
        lists = [words[i:i + 500] for i in range(0, len(words), 500)]
        for part, encoding in zip(lists, library.encode_batch_fast([" ".join(x) for x in lists], add_special_tokens=False)):
            ids = np.array(encoding.ids, "<u4")
            packed, cuts = ids.tobytes(), [0, *((np.flatnonzero(last[ids]) + 1) * 4).tolist()]
            if len(cuts) == len(part) + 1:
                found.update({c: packed[i:j] for c, i, j in zip(part, cuts, cuts[1:])})
        rest = [c for c in chunks if c not in found]
        for chunk, encoding in zip(rest, library.encode_batch_fast(rest, add_special_tokens=False)):
            found[chunk] = np.array(encoding.ids, "<u4").tobytes()
        return found

    def learn(chunks: list[str]) -> dict[str, bytes]:
        bodies = {c: c[:-1] for c in chunks if parts_marks and c[-1] in MARKS and c.isascii() and c[:-1].isalpha()}
        plain = dict.fromkeys([c for c in chunks if c not in bodies] + [b for b in bodies.values() if b not in known])
        ids, marks = looked_up(list(plain)), looked_up(list(MARKS))
        return ids | {c: (ids[b] if b in ids else known[b]) + marks[c[-1]] for c, b in bodies.items()}

    def encode(texts: list[str]) -> list[bytes]:
        known.renew(KEPT_CHUNKS)
        cut = [(t.lower() if parts_marks and t.isascii() and "<|" not in t else t).replace("\n", " ").split(" ") for t in texts]
        different = set()
        for chunks in cut:
            different.update(chunks)
        different.discard("")
        learnt = learn(known.missing(different))
        known.update(learnt)
        known[""] = b""
        out = [b"".join([known[c] for c in chunks]) for chunks in cut]
        for chunk in [c for c in learnt if len(c) > KEPT_LENGTH]:
            del known[chunk]
        return out

    return encode


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, name: str = "doc_id", text: str = "text",
          partition_bytes: int = PARTITION_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Encodes documents and writes token files below ``path``, in ascending order of ``name``.

    Nulls of ``name`` come first; rows of one name are ordered by a hash of their text. Null and empty texts
    hold the end id alone. Other columns are left out. No rows: no documents in any file.
    """
    source = docs.select(F.col(f"`{name}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Names and text hashes are spread evenly, so a name that many rows share is cut as well.
    order = ["doc_id", F.xxhash64("text")]
    ordered = source.repartitionByRange(max(1, -(-total // partition_bytes)), *order).sortWithinPartitions(*order)
    with open(tokenizer, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches) -> Iterator[pa.RecordBatch]:
        encode, end = word_encoder(content.value), np.uint32(end_id).tobytes()
        partition = TaskContext.get().partitionId()
        file = Writer(partition, 0)
        for batch in text_slices(batches):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                file.add(doc, ids + end)
                if file.size >= file_bytes:
                    yield _record(file.content())
                    file = Writer(partition, file.number + 1)
        if file.frames:
            yield _record(file.content())

    ordered.mapInArrow(run, "file binary").select(F.col("file").cast("string")).write.option(
        "maxRecordsPerFile", 1).option("compression", "none").text(path)


def _record(content: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["file"])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 9").select("content")


def read(spark: SparkSession, path: str, wanted: set[int] | None = None) -> DataFrame:
    """The documents of token files: ``doc_id``, ``start`` (tokens of all documents before it), ``n_tokens``
    and ``ids`` (binary). ``wanted`` limits what is decompressed to the documents of these ids, a set that
    is sent to every task. A damaged frame raises an error when it is read."""
    def heads(batches):
        for batch in batches:
            for content in batch.column("content"):
                file = Reader(content.as_buffer())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file.partition]), pa.array([file.number]), pa.array([int(file.tokens.sum())])],
                    names=["partition", "number", "tokens"])

    def documents(batches):
        for batch in batches:
            for content in batch.column("content"):
                file = Reader(content.as_buffer())
                starts = np.concatenate([[0], np.cumsum(file.tokens)])
                picked = [i for i, name in enumerate(file.names) if wanted is None or name in wanted]
                for first in range(0, len(picked), 1000):
                    part = picked[first:first + 1000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([file.partition] * len(part), pa.int64()), pa.array([file.number] * len(part), pa.int64()),
                        pa.array([file.names[i] for i in part], pa.int64()), pa.array(starts[part], pa.int64()),
                        pa.array(file.tokens[part], pa.int64()), pa.array([file.document(i) for i in part], pa.binary())],
                        names=["partition", "number", "doc_id", "inside", "n_tokens", "ids"])

    files = _files(spark, path)
    totals = files.mapInArrow(heads, "partition long, number long, tokens long")
    # One row per writing task, whatever its documents: their running sum is small.
    of_partitions = totals.groupBy("partition").agg(F.sum("tokens").alias("sum")).select(
        "partition", (F.sum("sum").over(Window.orderBy("partition")) - F.col("sum")).alias("before"))
    of_files = totals.select("partition", "number", (F.sum("tokens").over(
        Window.partitionBy("partition").orderBy("number")) - F.col("tokens")).alias("earlier"))
    begins = of_files.join(of_partitions, "partition").select(
        "partition", "number", (F.col("before") + F.col("earlier")).alias("begin"))
    rows = files.mapInArrow(documents, "partition long, number long, doc_id long, inside long, n_tokens long, ids binary")
    if len(files.inputFiles()) <= MOST_FILES_SENT:
        begins = F.broadcast(begins)
    return rows.join(begins, ["partition", "number"]).select(
        "doc_id", (F.col("begin") + F.col("inside")).alias("start"), "n_tokens", "ids")


