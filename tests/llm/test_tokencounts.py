import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, normalizers

from huntframe.llm import tokencounts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library_of(pieces):
    vocabulary = [("<unk>", 0.0), *[(f"<0x{b:02X}>", 0.0) for b in range(256)], *pieces.items()]
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return library


@pytest.fixture(scope="module")
def pieces():
    return tokencounts.read_pieces(PATH)


def test_counts_as_the_library(pieces, plain_rows):
    rng = random.Random(5)
    letters = [*" \n\t\r'stremvlda éßÀあ漢字😀1½▁0.,!-_", "the", "  ", "aaaa"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += ["", "a" * 3000, " " * 50, "\n\n", "▁"] + [t for _, t in plain_rows[:60]]
    expected = library_of(pieces).encode_batch(texts, add_special_tokens=False)
    counter = tokencounts.Counter(pieces)
    for text, (n, _), found in zip(texts, counter.totals(texts), expected):
        assert n == len(found.ids), text


def test_ties_go_to_the_earlier_start():
    # "ab" + "c" and "a" + "bc" score alike, as do "abc" and three pieces
    pieces = {"▁": 0.0, "a": -1.0, "b": -1.0, "c": -1.0, "ab": -2.0, "bc": -2.0, "abc": -3.0, "cc": -2.0}
    library, counter = library_of(pieces), tokencounts.Counter(pieces)
    for text in ("abc", "abcc", "bcc", "cab", "aabbcc", "abcabc", "ccc"):
        assert counter.totals([text])[0][0] == len(library.encode(text).ids), text


def test_score_is_that_of_the_best_way(pieces):
    counter = tokencounts.Counter(pieces)
    text = "▁hello"

    def best(rest):
        if not rest:
            return 0.0
        ways = [score + best(rest[len(p):]) for p, score in pieces.items() if rest.startswith(p)]
        return max(ways)

    assert counter.totals(["hello"])[0][1] == best(text)


def test_odd_rows(documents, odd_rows, pieces):
    docs = documents(odd_rows).withColumnRenamed("source", "n_tokens")
    library = library_of(pieces)
    rows = tokencounts.count_tokens(docs, PATH).collect()
    assert len(rows) == len(odd_rows)
    for row in rows:
        assert row.n_tokens == len(library.encode(row.text or "").ids)
    assert tokencounts.count_tokens(documents([]), PATH).collect() == []


def test_unsupported_vocabulary():
    with pytest.raises(ValueError):
        tokencounts.Counter({"a▁b": -1.0})
