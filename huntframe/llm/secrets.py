"""Secrets in whole texts: named patterns, and strings whose characters are too evenly spread for words.

A candidate is a longest run of the characters of one class. A window of fixed length slides over it; entering and
leaving characters change the sum of c * log2(c) over the window's counts, from which its Shannon entropy follows.
The sum is kept in whole numbers, so a window's verdict does not depend on where the sliding began.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from huntframe.llm.text import text_bytes, text_slices

#: Kinds with a pattern, in the order in which they are listed; the characters of a match that must be there at least.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ACCESS_WORDS = (b"AKIA",)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

#: Known strings that look like secrets, searched in a candidate with up to CONTEXT bytes before it.
ALLOWED = (
    rb"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",  # random identifiers
    rb"(?i)(?:md5|sha-?1|sha-?256|sha-?384|sha-?512|blake2b?)[\x20\"']*[:=-][\x20\"']*[A-Za-z0-9+/=_-]+$",  # digests
    rb"(?i)data:[a-z]+/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=_-]*$",  # embedded files
    rb"(?i)example|abcdefghijklm|0123456789abcdef",  # stand-ins
)
CONTEXT = 64

#: Fixed-point places of c * log2(c).
_PLACES = 1 << 32
#: Characters of candidates that are looked at together; a longer run is cut into overlapping pieces.
_TOGETHER = 1 << 20


@dataclass(frozen=True)
class CharacterClass:
    """Characters of candidates, the window's length and the bits per character from which a window is suspect."""

    kind: str
    characters: bytes
    window: int
    bits: float

    def __post_init__(self):
        if self.window < 2 or not self.characters:
            raise ValueError("a class needs characters and a window of two characters or more")

    @property
    def most(self) -> int:
        """The largest sum of c * log2(c) of a suspect window."""
        return int(np.floor((np.log2(self.window) - self.bits) * self.window * _PLACES))


_DIGITS, _SMALL, _LARGE = b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharacterClass("entropy_hex", _DIGITS + b"abcdefABCDEF", 32, 3.3),
    CharacterClass("entropy_base64", _DIGITS + _SMALL + _LARGE + b"+/=_-", 24, 4.0),
)

SPAN = T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.LongType(), False),
                     T.StructField("end", T.LongType(), False)])


def costs(window: int) -> np.ndarray:
    """c * log2(c) for the counts 0 to ``window``, in fixed point."""
    counts = np.arange(window + 1, dtype=np.float64)
    return np.rint(counts * np.log2(np.maximum(counts, 1)) * _PLACES).astype(np.int64)


def _runs(inside: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of at least ``least`` members; runs end with their text."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.empty(len(inside), bool)  # no member of the same text comes before
    fresh[0], fresh[1:] = True, ~inside[:-1]
    fresh[offsets[:-1][offsets[:-1] < len(inside)]] = True
    over = np.empty(len(inside), bool)
    over[-1], over[:-1] = True, fresh[1:] | ~inside[1:]
    starts, ends = np.flatnonzero(inside & fresh), np.flatnonzero(inside & over) + 1
    kept = ends - starts >= least
    return starts[kept], ends[kept]


def _places(whole: bytes, words: Iterable[bytes]) -> list[int]:
    """Where one of the words begins, in order."""
    found = []
    for word in words:
        at = whole.find(word)
        while at >= 0:
            found.append(at)
            at = whole.find(word, at + 1)
    return sorted(found)


def suspect_windows(codes: np.ndarray, run: np.ndarray, window: int, most: int) -> np.ndarray:
    """Which positions end a window of small cost; ``run`` numbers the candidates, in order.

    The count of a character in a window is the difference of two places in the list of its positions; every step
    adds what the entering character adds and takes off what the leaving one had added.
    """
    n = len(codes)
    cost = costs(window)
    at = np.arange(n)
    first = np.searchsorted(run, run)  # where the candidate begins
    key = run.astype(np.int64) * 256 + codes
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    wide = np.int64(n + 1)
    place = sorted_key * wide + order  # ascending: positions per candidate and character
    rank = np.empty(n, np.int64)
    rank[order] = at
    begin = np.maximum(at - window + 1, first)
    # occurrences from the window's begin up to here, this one included
    entering = rank - np.searchsorted(place, key * wide + begin) + 1
    change = cost[entering] - cost[entering - 1]
    # the character that leaves has this many occurrences up to the position before this one
    leaves = at - window
    leaves, now = leaves[leaves >= first], at[leaves >= first]
    held = np.searchsorted(place, key[leaves] * wide + now) - rank[leaves]
    change[now] -= cost[held] - cost[held - 1]
    change[now[key[leaves] == key[now]]] = 0  # one leaves, one of the same enters
    total = np.cumsum(change)
    before = np.where(first > 0, total[first - 1], 0)
    return (at - first >= window - 1) & (total - before <= most)


def _suspects(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: CharacterClass) -> Iterator[tuple[int, int, int]]:
    """(candidate, start, end) of every suspect window, in order."""
    w = kind.window
    pieces, held = [], 0

    def looked_at():
        if not pieces:
            return
        codes = np.concatenate([data[s:e] for _, s, e in pieces])
        sizes = np.array([e - s for _, s, e in pieces])
        number = np.repeat(np.arange(len(pieces)), sizes)
        shift = np.repeat(np.array([s for _, s, _ in pieces]) - (np.cumsum(sizes) - sizes), sizes)
        hot = np.flatnonzero(suspect_windows(codes, number, w, kind.most))
        for i in hot.tolist():
            yield pieces[number[i]][0], i + int(shift[i]) - w + 1, i + int(shift[i]) + 1

    for c, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        while True:
            stop = min(e, s + _TOGETHER)
            pieces.append((c, s, stop))
            held += stop - s
            if held >= _TOGETHER:
                yield from looked_at()
                pieces, held = [], 0
            if stop == e:
                break
            s = stop - w + 1
    yield from looked_at()


def _joined(windows: Iterable[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Windows of one candidate that overlap or touch, as one span."""
    held = None
    for c, s, e in windows:
        if held and held[0] == c and s <= held[2]:
            held = (c, held[1], e)
        else:
            if held:
                yield held
            held = (c, s, e)
    if held:
        yield held


class Scanner:
    """Finds the spans of all kinds in slices of texts."""

    def __init__(self, classes: Iterable[CharacterClass] = CLASSES, allowed: Iterable[bytes] = ALLOWED):
        self.classes = tuple(classes)
        self.allowed = [re.compile(p) for p in allowed]
        self.member = [np.isin(np.arange(256), np.frombuffer(c.characters, np.uint8)) for c in self.classes]
        self.hex = np.isin(np.arange(256), np.frombuffer(_DIGITS + b"abcdef", np.uint8))

    def _suppressed(self, text: bytes, low: int, start: int, end: int) -> bool:
        around = text[max(low, start - CONTEXT):end]
        return any(p.search(around) for p in self.allowed)

    def scan(self, array: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Per text the (start, kind number, end) of its spans, in characters; null is empty."""
        data, offsets = text_bytes(array)
        whole = data.tobytes()
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(array))]
        borders = offsets.tolist()
        for kind, pattern, group, least, places in (
                (0, ASSIGN, 1, ASSIGN_LEAST, _places(whole.lower(), ASSIGN_WORDS)),
                (1, ACCESS, 0, ACCESS_LEAST, _places(whole, ACCESS_WORDS))):
            over = 0
            for at in places:
                i = bisect_right(borders, at) - 1
                m = pattern.match(whole, at, borders[i + 1]) if at >= over else None
                if m:
                    over = m.end()
                    if m.end(group) - m.start(group) >= least:
                        found[i].append((at, kind, over))
        for s, e in zip(*(x.tolist() for x in _runs(self.hex[data], offsets, HEX_LEAST))):
            found[bisect_right(borders, s) - 1].append((s, 2, e))
        base = [list(f) for f in found]
        for number, (kind, member) in enumerate(zip(self.classes, self.member)):
            starts, ends = _runs(member[data], offsets, kind.window)
            allowed: dict[int, bool] = {}
            for c, s, e in _joined(_suspects(data, starts, ends, kind)):
                i = bisect_right(borders, s) - 1
                if c not in allowed:
                    allowed[c] = self._suppressed(whole, borders[i], int(starts[c]), int(ends[c]))
                if not allowed[c] and not any(b <= s and e <= f for b, _, f in base[i]):
                    found[i].append((s, 3 + number, e))
        for i, spans in enumerate(found):
            if spans:
                spans.sort()
                low, high = borders[i], borders[i + 1]
                opens = np.concatenate([[0], np.cumsum((data[low:high] & 0xC0) != 0x80)])
                found[i] = [(int(opens[s - low]), k, int(opens[e - low])) for s, k, e in spans]
        return found


def scan(documents: DataFrame, text: str = "text", to: str = "secrets",
         classes: Iterable[CharacterClass] = CLASSES, allowed: Iterable[bytes] = ALLOWED) -> DataFrame:
    """Adds ``to``, the spans (kind, start, end) of secrets in the whole text, by start, then kind as listed.

    Kinds: ``assign``, ``access`` and ``hex`` have patterns; each of ``classes`` adds a kind of its own. Positions count
    characters (code points), the end is exclusive. A span of a class that lies within a span of a pattern is left out,
    as is every span of a candidate in which, or right before which, a pattern of ``allowed`` is found; the spans of
    patterns always stay. Null and empty texts have no spans. Every row stays, repeated rows and rows without an id as
    well; other columns are kept, and a column that is already named ``to`` is replaced. Any text is read whole.
    """
    classes, allowed = tuple(classes), tuple(allowed)
    kinds = ["assign", "access", "hex", *[c.kind for c in classes]]
    if len(set(kinds)) < len(kinds):
        raise ValueError("two kinds have one name")
    if to == text:
        raise ValueError("the spans need a column of their own")
    kept = documents.drop(to)
    schema = T.StructType([*kept.schema.fields, T.StructField(to, T.ArrayType(SPAN, False), False)])
    span_type = pa.struct([pa.field("kind", pa.string(), False), pa.field("start", pa.int64(), False),
                           pa.field("end", pa.int64(), False)])
    list_type = pa.list_(pa.field("element", span_type, False))

    def batches(incoming):
        scanner = Scanner(classes, allowed)
        for piece in text_slices(incoming, text):
            spans = scanner.scan(piece.column(text))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int32)
            flat = [x for s in spans for x in s]
            values = pa.StructArray.from_arrays(
                [pa.array([kinds[k] for _, k, _ in flat], pa.string()), pa.array([s for s, _, _ in flat], pa.int64()),
                 pa.array([e for _, _, e in flat], pa.int64())], fields=list(span_type))
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values).cast(list_type)
            yield pa.RecordBatch.from_arrays([*piece.columns, column],
                                             schema=pa.schema([*piece.schema, pa.field(to, list_type, False)]))

    return kept.mapInArrow(batches, schema)
