"""Benchmark passages in documents, found with a generalised suffix automaton of the benchmark's words.

The automaton holds every run of words of every test item. A document's words are streamed through it
while the length of the longest match that ends at each word is tracked; where that length reaches a
window (``window`` words, or a whole item that is shorter) those words are hit. The automaton is built
from a bounded part of the benchmark; a larger benchmark is worked off part by part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntframe.llm.share import Shared
from huntframe.llm.text import ALPHANUMERIC, Powers, Words, byte_codes, text_bytes, text_slices

PART_WORDS = 100_000  # benchmark words in one automaton, and so in memory and in one broadcast


class SuffixAutomaton:
    """All runs of words of several sequences. Words are integers."""

    def __init__(self, items: list[tuple[object, list[int]]], window: int):
        self.window = window
        self.next, self.link, self.length = [{}], [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self._mark(items)

    def _extend(self, last: int, word: int) -> int:
        step, link, length = self.next, self.link, self.length
        known = step[last].get(word)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._split(last, known, word)
        state = self._state(length[last] + 1, {}, 0)
        while last >= 0 and word not in step[last]:
            step[last][word] = state
            last = link[last]
        if last >= 0:
            known = step[last][word]
            link[state] = known if length[known] == length[last] + 1 else self._split(last, known, word)
        return state

    def _split(self, last: int, known: int, word: int) -> int:
        step, link, length = self.next, self.link, self.length
        copy = self._state(length[last] + 1, dict(step[known]), link[known])
        link[known] = copy
        while last >= 0 and step[last].get(word) == known:
            step[last][word] = copy
            last = link[last]
        return copy

    def _state(self, length: int, step: dict, link: int) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _mark(self, items) -> None:
        """For every state the windows that end where it is reached: full ones, and whole short items."""
        count, window = len(self.length), self.window
        whole: dict[int, dict[int, set]] = {}  # state -> length -> short items
        self.full_items: dict[int, set] = {}  # state that holds full windows -> items with that window
        order = sorted(range(1, count), key=self.length.__getitem__)
        self.full = [0] * count  # the state of the last ``window`` words, 0 if there are fewer
        for state in order:
            if self.length[state] >= window:
                above = self.link[state]
                self.full[state] = self.full[above] if self.length[above] >= window else state
        for name, words in items:
            state = 0
            for word in words:
                state = self.next[state][word]
                if self.full[state]:
                    self.full_items.setdefault(self.full[state], set()).add(name)
            if 0 < len(words) < window:
                whole.setdefault(state, {}).setdefault(len(words), set()).add(name)
        self.short: list[tuple] = [()] * count  # (length, items), also of all suffixes
        for state in order:
            own = [(n, frozenset(names)) for n, names in whole.get(state, {}).items()]
            self.short[state] = (*own, *self.short[self.link[state]])

    def matches(self, words) -> list[tuple[int, int, object]]:
        """Windows in a sequence: first word, word after the last one, items that hold the window."""
        step, link, length, found = self.next, self.link, self.length, []
        state = matched = 0
        for at, word in enumerate(words, 1):
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            state = step[state].get(word, 0)
            matched = matched + 1 if state else 0
            if matched >= self.window:
                full = self.full[state]
                found.append((at - self.window, at, self.full_items[full]))
            for n, names in self.short[state]:
                if matched >= n:
                    found.append((at - n, at, names))
        return found


class BenchmarkPart:
    """An automaton and what is needed to pass over text that cannot match."""

    def __init__(self, items: list[tuple[object, list[int]]], window: int):
        items = [(name, words) for name, words in items if len(words)]
        self.shortest = min([window, *[len(words) for _, words in items]])
        self.words = np.unique(np.array([w for _, words in items for w in words], np.uint64))
        numbered = [(name, np.searchsorted(self.words, np.array(words, np.uint64)).tolist()) for name, words in items]
        self.automaton = SuffixAutomaton(numbered, window)
        pairs = [a * len(self.words) + b for _, words in numbered for a, b in zip(words, words[1:])]
        self.pairs = np.unique(np.array(pairs, np.int64))

    def matches(self, words: Words) -> list[tuple[int, int, object]]:
        """Windows in a slice of texts, by word positions in the slice."""
        if not len(words) or not len(self.words):
            return []
        number = np.minimum(np.searchsorted(self.words, words.hash), len(self.words) - 1)
        known = self.words[number] == words.hash
        # Only a run of known words whose neighbours all stand together in the benchmark can hold a window.
        joins = np.zeros(len(words) + 1, bool)
        both = np.flatnonzero(known[:-1] & known[1:] & (words.text[:-1] == words.text[1:]))
        if len(self.pairs):
            pair = number[both] * len(self.words) + number[both + 1]
            near = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joins[both[self.pairs[near] == pair] + 1] = True
        starts = np.flatnonzero(known & ~joins[:-1])
        ends = np.flatnonzero(known & ~joins[1:]) + 1
        found = []
        for start, end in zip(starts[ends - starts >= self.shortest].tolist(), ends[ends - starts >= self.shortest].tolist()):
            found += [(start + a, start + b, names) for a, b, names in self.automaton.matches(number[start:end].tolist())]
        return found


def benchmark_words(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Each item's words as 64-bit hashes."""
    source = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        powers, codes = Powers(), byte_codes()
        for batch in text_slices(batches):
            words = Words(*text_bytes(batch.column("text")), ALPHANUMERIC, powers, codes)
            hashes = words.hash.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), pa.ListArray.from_arrays(words.border.astype(np.int32), hashes)],
                names=["item", "words"])

    return source.mapInArrow(run, "item string, words array<long>")


def benchmark_parts(benchmark: DataFrame, window: int, item: str, text: str, part_words: int):
    """The benchmark as broadcast automata, each made of items with about ``part_words`` words."""
    spark = benchmark.sparkSession
    words = benchmark_words(benchmark, item, text)
    total = words.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = max(1, -(-total // part_words))
    for part in range(parts):
        rows = words.filter(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == part).collect()
        items = [(r.item, [w % (1 << 64) for w in r.words]) for r in rows]
        yield Shared(spark, BenchmarkPart(items, window))


FOUND = "array<struct<start:int,end:int>>"


def mark(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item: str = "item_id",
         item_text: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """Adds ``n_words``, ``n_hit``, ``items`` (sorted ids as text) and ``spans`` (bytes of the hit runs).

    Words are runs of ASCII letters, digits and non-ASCII characters, in small letters; words are compared
    by 64-bit hashes. An item with fewer words than ``window`` is a window as a whole, one without words
    has none. Words of an item without an id are hit as well, only ``items`` does not name it. A null or empty text has no words and no hits. Every row is judged alone.
    Existing columns with the names of the new ones are replaced.
    """
    new = ["n_words", "n_hit", "items", "spans"]
    carried = [c for c in docs.columns if c not in new]
    kept = T.StructType([docs.schema[c] for c in carried])
    schema = T.StructType([*kept.fields, *T._parse_datatype_string(
        f"n_words long, n_hit long, items array<string>, spans {FOUND}").fields])
    marked = docs.select(*[F.col(f"`{c}`") for c in carried])
    for i, part in enumerate(benchmark_parts(benchmark, window, item, item_text, part_words)):
        marked = marked.mapInArrow(_marker(part, carried, text, merge=i > 0), schema)
    return marked


def _marker(part, carried: list[str], text: str, merge: bool):
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        powers, codes, known = Powers(), byte_codes(), part.value
        for batch in text_slices(batches, text):
            data, offsets = text_bytes(batch.column(text))
            words = Words(data, offsets, ALPHANUMERIC, powers, codes)
            edges = np.zeros(len(words) + 1, np.int64)
            items: dict[int, set] = {}
            for start, end, names in known.matches(words):
                edges[start] += 1
                edges[end] -= 1
                items.setdefault(int(words.text[start]), set()).update(n for n in names if n is not None)
            hit = np.cumsum(edges[:-1]) > 0
            if merge:
                for row, (spans, names) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())):
                    for span in spans:
                        first, last = np.searchsorted(words.start, [span["start"] + offsets[row], span["end"] + offsets[row]])
                        hit[first:last] = True
                    if names:
                        items.setdefault(row, set()).update(names)
            total = np.concatenate([[0], np.cumsum(hit)])
            # runs of hit words inside one text
            same = words.text[1:] == words.text[:-1]
            goes_on = np.concatenate([[False], hit[:-1] & hit[1:] & same])
            first = np.flatnonzero(hit & ~goes_on)
            last = np.flatnonzero(hit & ~np.append(goes_on[1:], False))
            base = offsets[words.text[first]]
            spans = pa.ListArray.from_arrays(
                np.searchsorted(words.text[first], np.arange(len(offsets))).astype(np.int32),
                pa.StructArray.from_arrays([pa.array((words.start[first] - base).astype(np.int32)),
                                            pa.array((words.end[last] - base).astype(np.int32))], ["start", "end"]))
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in carried],
                pa.array(np.diff(words.border)), pa.array(np.diff(total[words.border])),
                pa.array([sorted(items.get(i, ())) for i in range(batch.num_rows)], pa.list_(pa.string())),
                spans.cast(spans_type)], names=[*carried, "n_words", "n_hit", "items", "spans"])

    return run


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_covered: float = 0.5,
           text: str = "text", **names) -> DataFrame:
    """Cuts the hit runs out of the texts, and drops documents of which more than ``most_covered`` of the
    words are hit. Documents without a hit, null and empty texts come back as they are."""
    marked = mark(docs, benchmark, window, text, **names)
    kept = marked.filter((F.col("n_hit") == 0) | (F.col("n_hit") <= F.lit(most_covered) * F.col("n_words")))
    whole = F.col(f"`{text}`").cast("binary")
    # what lies between the spans: (end of the span before, start of the span after)
    begins = F.concat(F.array(F.lit(0)), F.col("spans.end"))
    ends = F.concat(F.col("spans.start"), F.array(F.octet_length(whole)))
    pieces = F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda s: F.substring(
        whole, s["b"] + 1, s["e"] - s["b"]))
    rest = F.aggregate(pieces, F.lit(b""), lambda a, p: F.concat(a, p)).cast("string")
    return kept.withColumn(text, F.when(F.col("n_hit") > 0, rest).otherwise(F.col(f"`{text}`"))).select(
        *[F.col(f"`{c}`") for c in docs.columns])
