"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntframe.llm.shards import _release
from huntframe.llm.text import ALPHANUMERIC, Powers, Words, byte_codes, chained, mixed, text_bytes, text_slices

SLICE = 512 << 10  # bytes of text that a task looks at together
LONGEST = 1 << 20  # bytes of the longest text that is fitted on, unless another bound is given


def bounded_sample(rows: DataFrame, label: str, most_rows: int, most_bytes: int, size: str = "bytes",
                   key: str = "doc_id", longest: int = LONGEST) -> DataFrame:
    """(key, label, draw): at most ``most_rows`` rows and about ``most_bytes`` bytes of each label, no text of more than
    ``longest`` bytes.

    ``rows`` holds key, label and the size of the text, not the text. Rows are drawn by a hash of their key,
    so a repeated task draws the same ones. ``draw`` is a number in [0, 1) that is spread evenly over the
    rows drawn, for splitting the sample.
    """
    spread = F.lit(float(1 << 30))
    at = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) / spread
    sized = rows.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & (F.col(size) <= longest)).select(
        key, label, size, at.alias("_at"))
    totals = sized.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_total"))
    share = F.least(F.lit(1.0), F.lit(float(most_rows)) / F.col("_n"),
                    F.lit(float(most_bytes)) / F.greatest(F.col("_total"), F.lit(1)))
    drawn = sized.join(totals.select(label, share.alias("_share")), label).filter(F.col("_at") < F.col("_share"))
    first = Window.partitionBy(label).orderBy("_at", key)
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("split")), F.lit(1 << 30)) / spread
    return drawn.withColumn("_row", F.row_number().over(first)).filter(F.col("_row") <= most_rows).select(
        key, label, draw.alias("draw"))


def with_texts(sample: DataFrame, documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The sample with its texts. The sample's rows are bounded, so they go to the documents."""
    return documents.select(key, F.col(text).alias("text")).join(F.broadcast(sample), key)


def near_copy_marks(documents: DataFrame, text: str = "text", key: str = "doc_id", marks: int = 6,
                    shingle: int = 3) -> DataFrame:
    """(key, bytes, marks): the smallest hash of each text's word shingles, in several orders.

    Exact copies have the same marks, near copies almost always share one.
    """
    schema = T.StructType([documents.schema[key], T.StructField("bytes", T.LongType()),
                           T.StructField("marks", T.ArrayType(T.LongType()))])

    def run(batches):
        powers, codes = Powers(), byte_codes()
        for batch in text_slices(batches, text, SLICE):
            data, offsets = text_bytes(batch.column(text))
            words = Words(data, offsets, ALPHANUMERIC, powers, codes)
            chain = words.hash
            for _ in range(shingle - 1):
                chain = chained(chain[:-1], words.hash[len(words) - len(chain) + 1:]) if len(chain) else chain
            smallest = np.empty((batch.num_rows, marks), np.uint64)
            for mark in range(marks):
                values = mixed(chain + np.uint64(mark))
                for i, (a, b) in enumerate(zip(words.border[:-1].tolist(), words.border[1:].tolist())):
                    smallest[i, mark] = values[a:b - shingle + 1].min() if b - a >= shingle \
                        else words.hash[a:b].sum(dtype=np.uint64)
            border = np.arange(batch.num_rows + 1, dtype=np.int32) * marks
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(border, smallest.ravel().view(np.int64))],
                names=[key, "bytes", "marks"])
        _release()

    return documents.select(key, text).mapInArrow(run, schema)


def without_near_copies(rows: DataFrame, key: str = "doc_id", within: str | None = None, least: int = 4) -> DataFrame:
    """Drops each row that shares at least ``least`` marks, of which it has six, with a row of a smaller key and the same
    value of ``within``, for fitting: a passage that is copied often says little. ``rows`` has ``marks``."""
    same = [] if within is None else [within]
    marked = rows.select(key, *same, F.posexplode("marks").alias("mark", "hash"))
    first = marked.groupBy(*same, "mark", "hash").agg(F.min(key).alias("first"))
    # Rows of a group share marks with its smallest key, so each row is compared with at most one row per mark.
    shared = marked.join(first, [*same, "mark", "hash"]).filter(F.col(key) > F.col("first"))
    later = shared.groupBy(key, "first").agg(F.countDistinct("mark").alias("n")).filter(F.col("n") >= least).select(key).distinct()
    return rows.join(later, key, "left_anti")
