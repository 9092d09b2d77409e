import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from huntframe.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_random_texts_as_the_library(library):
    rng = random.Random(3)
    letters = [*" \n\t\r'stremvlda éßÀあ漢字😀½²٣́‍\xa0\x85\x1c0.,!-_", "<|endoftext|>", "the", "  ", "aaaa", "　"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["a" * 5000, "ab" * 3000, "=" * 4000, " " * 300, "", "\n\n", " \n "]
    texts += [f"a{chr(c)}b {chr(c)} 1{chr(c)}" for c in range(0, 0x3100) if not 0xD800 <= c < 0xE000]
    encoder = bpe.Encoder(bpe.BytePairs(open(PATH, encoding="utf-8").read()))
    got = [i for part in range(0, len(texts), 500) for i in encoder.encode(texts[part:part + 500])]
    for text, packed, expected in zip(texts, got, library.encode_batch(texts, add_special_tokens=False)):
        assert ids_of(packed) == expected.ids, text


def test_forgotten_chunks_do_not_matter(library, monkeypatch, plain_rows):
    monkeypatch.setattr(bpe, "KEPT_CHUNKS", 50)
    encoder = bpe.Encoder(bpe.BytePairs(open(PATH, encoding="utf-8").read()))
    for _, text in plain_rows[:40]:
        assert ids_of(encoder.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids


def test_lower_rank_that_a_merge_opens_comes_first():
    # "ab" + "c" is ranked before "a" + "b": once an "ab" stands, it takes the "c" before the next "ab" is made.
    letters = {letter: byte for letter, byte in bpe.byte_letters().items()}
    vocabulary = {letter: i for i, letter in enumerate(letters)}
    for token in ("bc", "abc", "ab", "aba"):
        vocabulary[token] = len(vocabulary)
    spec = {"model": {"type": "BPE", "vocab": vocabulary, "merges": [["ab", "a"], ["a", "b"]]},
            "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True, "trim_offsets": True},
            "normalizer": None, "added_tokens": []}
    import json
    encoder = bpe.Encoder(bpe.BytePairs(json.dumps(spec)))
    spec["decoder"] = spec["post_processor"] = spec["truncation"] = spec["padding"] = None
    spec["version"] = "1.0"
    spec["model"] |= {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
                      "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    library = Tokenizer.from_str(json.dumps(spec))
    for text in ("abab", "ababab", "aabab", "abababa"):
        assert ids_of(encoder.encode([text])[0]) == library.encode(text).ids


def test_round_trip_of_odd_rows(documents, odd_rows, library):
    docs = documents(odd_rows).withColumnRenamed("source", "ids")
    encoded = bpe.encode(docs, PATH)
    assert encoded.columns == ["doc_id", "text", "lang", "n_chars", "ids", "n_tokens"]
    for row in bpe.decode(encoded.withColumnRenamed("text", "before"), PATH).collect():
        assert row.text == (row.before or "")
        assert ids_of(row.ids) == library.encode(row.before or "", add_special_tokens=False).ids
        assert row.n_tokens == len(row.ids) // 4


def test_specials_as_plain_text():
    encoder = bpe.Encoder(bpe.BytePairs(open(PATH, encoding="utf-8").read()), plain_specials=True)
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    text = "a <|endoftext|> b<|endoftext|>"
    assert ids_of(encoder.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids


def test_empty_table(documents):
    assert bpe.decode(bpe.encode(documents([]), PATH), PATH).collect() == []


def test_broken_utf8_becomes_replacement(spark):
    ids = np.array([bpe.BytePairs(open(PATH, encoding="utf-8").read()).first_id[0xE9]], "<u4").tobytes()
    rows = spark.createDataFrame([(1, bytearray(ids)), (2, None)], "doc_id long, ids binary")
    assert [r.text for r in bpe.decode(rows, PATH).orderBy("doc_id").collect()] == ["�", ""]
