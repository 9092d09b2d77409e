"""Language by words first, then by progressively shorter character n-grams.

A known word adds its log frequency in each language. A word that no language has is looked up by its
n-grams of five characters (padded with a blank on either side), and where none of them is known, by those of four,
three, two and one. Words are runs of letters and of marks on letters of any script, in small letters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntframe.llm.sampling import LONGEST, bounded_sample, with_texts
from huntframe.llm.share import Shared
from huntframe.llm.text import Powers, Words, letters, mixed, text_points, text_slices

SAMPLE_ROWS = 4_000  # labelled rows of each language
SAMPLE_BYTES = 4 << 20  # bytes of their texts, per language
LONGEST_GRAM = 5
UNKNOWN = "und"


def _grams(data: np.ndarray, words: Words, which: np.ndarray, size: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of some words, and the position in ``which`` of the word of each."""
    length = (words.end - words.start)[which] + 2
    border = np.concatenate([[0], np.cumsum(length)])
    padded = np.full(border[-1], 0x20, np.uint32)
    inside = np.arange(border[-1]) - np.repeat(border[:-1], length)
    body = (inside > 0) & (inside < np.repeat(length, length) - 1)
    padded[body] = data[(np.repeat(words.start[which], length) + inside - 1)[body]]
    owner = np.repeat(np.arange(len(which)), length)
    if len(padded) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    chars = codes[padded]
    value = np.full(len(padded) - size + 1, size, np.uint64)
    for i in range(size):
        value = value * np.uint64(0x9E3779B97F4A7C15) + chars[i:len(padded) - size + 1 + i]
    whole = owner[:len(value)] == owner[size - 1:]
    return mixed(value[whole]), owner[:len(value)][whole]


def _counts(sample: DataFrame, languages: list[str]) -> DataFrame:
    """(size, hash, lang, n) of words (size 0) and character n-grams of the sampled texts."""
    def run(batches):
        powers, (member, codes) = Powers(), letters()
        for batch in text_slices(batches):
            data, offsets = text_points(batch.column("text"))
            words = Words(data, offsets, member, powers, codes)
            lang = batch.column("_lang").to_numpy(zero_copy_only=False)[words.text]
            everyone = np.arange(len(words))
            found = [(0, words.hash, lang)]
            for size in range(1, LONGEST_GRAM + 1):
                grams, owner = _grams(data, words, everyone, size, codes)
                found.append((size, grams, lang[owner]))
            for size, hashes, langs in found:
                table = pa.table({"hash": hashes.view(np.int64), "lang": langs}).group_by(["hash", "lang"]).aggregate([([], "count_all")])
                yield from pa.table({"size": pa.array(np.full(len(table), size, np.int32)), "hash": table["hash"],
                                     "lang": table["lang"], "n": table["count_all"]}).to_batches()

    number = F.array_position(F.lit(languages), F.col("lang")) - 1
    rows = sample.select("text", number.cast("int").alias("_lang")).mapInArrow(run, "size int, hash long, lang int, n long")
    return rows.groupBy("size", "hash", "lang").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Log frequencies of words and n-grams per language; bounded by the size of the sample."""

    def __init__(self, languages: list[str], counts: dict[str, np.ndarray]):
        self.languages, self.tables = languages, []
        for size in range(LONGEST_GRAM + 1):
            rows = counts["size"] == size
            hashes, lang, n = counts["hash"][rows].view(np.uint64), counts["lang"][rows], counts["n"][rows]
            keys = np.unique(hashes)
            table = np.full((len(keys), len(languages)), 0.5)
            table[np.searchsorted(keys, hashes), lang] += n
            self.tables.append((keys, np.log(table / table.sum(axis=0)).astype(np.float32)))

    def found(self, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, _ = self.tables[size]
        if not len(keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return at, keys[at] == hashes

    def scores(self, data: np.ndarray, words: Words, texts: int, codes: np.ndarray) -> np.ndarray:
        """Mean log frequency per language of each text's words; null texts have zeros."""
        at, known = self.found(0, words.hash)
        of_word = np.zeros((len(words), len(self.languages)), np.float32)
        of_word[known] = self.tables[0][1][at[known]]
        # Every different unknown word is worked out once.
        strange, first, again = np.unique(words.hash[~known], return_index=True, return_inverse=True)
        left = np.flatnonzero(~known)[first]
        value = np.zeros((len(strange), len(self.languages)), np.float32)
        todo = np.arange(len(strange))
        for size in range(LONGEST_GRAM, 0, -1):
            if not len(todo):
                break
            grams, owner = _grams(data, words, left[todo], size, codes)
            at, hit = self.found(size, grams)
            n = np.bincount(owner[hit], minlength=len(todo))
            for lang in range(len(self.languages)):
                total = np.bincount(owner[hit], self.tables[size][1][at[hit], lang], minlength=len(todo))
                value[todo, lang] = np.where(n > 0, total / np.maximum(n, 1), value[todo, lang])
            todo = todo[n == 0]
        of_word[~known] = value[again]
        sums = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(of_word, axis=0, dtype=np.float64)])
        return (sums[words.border[1:]] - sums[words.border[:-1]]) / np.maximum(np.diff(words.border), 1)[:, None]


def fit(documents: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES,
        longest: int = LONGEST) -> LanguageModel | None:
    """A model from ``documents`` (doc_id, text, lang); None if no row has both text and lang.

    Fitted on a sample of at most ``sample_rows`` rows and about ``sample_bytes`` bytes per language, of texts of at
    most ``longest`` bytes.
    """
    labelled = documents.filter("text is not null and lang is not null")
    sizes = labelled.select("doc_id", "lang", F.octet_length("text").alias("bytes"))
    sample = with_texts(bounded_sample(sizes, "lang", sample_rows, sample_bytes, longest=longest), labelled.drop("lang")).persist()
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())
    if not languages:
        return None
    counts = _counts(sample, languages).toArrow()
    sample.unpersist()
    return LanguageModel(languages, {c: counts.column(c).to_numpy() for c in counts.column_names})


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``, the predicted language's share of the belief (0 to 1).

    Texts that are null or have no letter get ``und`` with score 0; so do all if there is no model. A tie
    goes to the language that sorts first. Rows are judged one by one; columns of these names are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = Shared(docs.sparkSession, model)

    def run(batches):
        powers, (member, codes), known = Powers(), letters(), shared.value
        names = np.array(known.languages, object)
        for batch in text_slices(batches, text):
            data, offsets = text_points(batch.column(text))
            words = Words(data, offsets, member, powers, codes)
            scores = known.scores(data, words, batch.num_rows, codes)
            # A text of many words says no more than a dozen of them, lest every score be 0 or 1.
            belief = scores * np.minimum(np.diff(words.border), 12)[:, None]
            belief = np.exp(belief - belief.max(axis=1, keepdims=True))
            best = scores.argmax(axis=1)
            share = belief[np.arange(len(best)), best] / belief.sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(share)],
                                             names=[*batch.schema.names, "lang_pred", "score"])

    letter = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    return docs.mapInArrow(run, schema).withColumns({
        "lang_pred": F.when(letter, F.col("lang_pred")).otherwise(UNKNOWN),
        "score": F.when(letter, F.col("score")).otherwise(0.0)})
