import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from huntframe.llm import tokenfile
from huntframe.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


def written(spark, docs, **options):
    path = scratch_path(spark, "tokens")
    tokenfile.write(docs, path, PATH, end_id=1, **options)
    return path


def test_many_files(spark, documents, plain_rows, library):
    path = written(spark, documents(plain_rows), partition_bytes=60_000, file_bytes=4_000)
    assert len([f for f in spark.read.format("binaryFile").load(path).select("path").collect()]) > 20
    rows = tokenfile.read(spark, path).orderBy("doc_id").collect()
    start = 0
    for (name, text), row in zip(plain_rows, rows, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert (row.doc_id, row.start, row.n_tokens, ids_of(row.ids)) == (name, start, len(ids), ids)
        start += len(ids)


def test_only_the_wanted_documents(spark, documents, plain_rows):
    path = written(spark, documents(plain_rows), partition_bytes=60_000)
    everything = {r.doc_id: r for r in tokenfile.read(spark, path).collect()}
    some = tokenfile.read(spark, path, {3, 150}).collect()
    assert sorted(r.doc_id for r in some) == [3, 150]
    assert all(r == everything[r.doc_id] for r in some)


def test_odd_rows_and_empty_table(spark, documents, odd_rows, library):
    rows = tokenfile.read(spark, written(spark, documents(odd_rows), partition_bytes=1000)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted([i for i, _ in odd_rows], key=lambda i: (i is not None, i))
    expected = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in odd_rows)
    assert sorted((str(r.doc_id), ids_of(r.ids)) for r in rows) == expected
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    assert tokenfile.read(spark, written(spark, documents([]))).collect() == []


def test_a_file_is_a_zstandard_stream_and_notices_damage():
    writer = tokenfile.Writer(3, 4)
    parts = [np.arange(n, dtype="<u4").tobytes() for n in (5, 0, 100)]
    for name, part in zip((7, None, 9), parts):
        writer.add(name, part)
    content = writer.content() + b"\n"
    stream = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True)
    assert stream.read() == b"".join(parts)
    reader = tokenfile.Reader(content)
    assert (reader.partition, reader.number, reader.names) == (3, 4, [7, None, 9])
    assert [bytes(reader.document(i)) for i in range(3)] == parts
    assert [len(p) // 4 for p in parts] == reader.tokens.tolist()
    damaged = bytearray(content)
    damaged[-10 - 9 - 12 + 8] ^= 1  # the last frame's checksum
    with pytest.raises(ValueError):
        tokenfile.Reader(bytes(damaged)).document(2)
    with pytest.raises(ValueError):
        tokenfile.Reader(content[:-2])


def test_checksum_column(spark, documents):
    row = tokenfile.read(spark, written(spark, documents([(1, "the the")]))).withColumn("crc", F.crc32("ids")).first()
    assert row.crc == zlib.crc32(bytes(row.ids))


def test_chunks_encode_as_whole_texts(library):
    texts = ["Don't  STOP\n\nnow", " é́ \x1c a\tb", "<|endoftext|> x", "", " ", "ΑΣ ΑΣ\xa0ß", "a\n b"]
    encode = tokenfile.word_encoder(open(PATH, encoding="utf-8").read())
    assert [ids_of(i) for i in encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_special_tokens_in_other_case_are_ordinary_text(library):
    texts = ["One <|EndOfText|> Two", "a<|STARTOFTEXT|>B", "<|endoftext|> X", "Plain Words"]
    encoded = tokenfile.word_encoder(open(PATH).read())(texts)
    assert [ids_of(b) for b in encoded] == [library.encode(t, add_special_tokens=False).ids for t in texts]
