"""Whole texts as numpy arrays: slices of bounded size, word borders and 64-bit word hashes."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_SEED = 20240131
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def text_slices(batches, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in slices of about ``most`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start, before = 0, 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, end - start)
            start, before = end, int(ends[end - 1])


class Remembered(dict):
    """Results by chunk of text, in two generations: the older one is dropped when the newer one is full."""

    older: dict = {}

    def renew(self, most: int) -> None:
        if len(self) > most:
            self.older = dict(self)
            self.clear()

    def missing(self, wanted: set) -> list[str]:
        """What is not known, in a fixed order; known entries of the older generation become new ones."""
        wanted = wanted.difference(self)
        again = wanted.intersection(self.older)
        self.update({c: self.older[c] for c in again})
        return sorted(wanted - again)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (one more for the end). Null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = pc.fill_null(array, b"" if pa.types.is_binary(array.type) else "")
    large = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, places, data = array.buffers()
    if places is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offsets = np.frombuffer(places, np.int64 if large else np.int32)[array.offset:array.offset + len(array) + 1]
    offsets = offsets.astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def _table(belongs) -> np.ndarray:
    return np.array([belongs(b) for b in range(256)], bool)


# Which bytes make words. Bytes from 0x80 up are parts of non-ASCII characters.
SPACED = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
ALPHANUMERIC = _table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
LETTERS = _table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def byte_codes() -> np.ndarray:
    """A fixed random number for each byte, the same for a capital and its small letter."""
    codes = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    return codes[_LOWER]


@functools.cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is part of a word, a letter or a mark on one, and a fixed random number, the
    same for a capital and its small letter. Made once in each worker."""
    points = range(sys.maxunicode + 1)
    member = np.array([unicodedata.category(chr(p))[0] in "LM" for p in points], bool)
    small = np.arange(len(points), dtype=np.uint64)
    for p in np.flatnonzero(member).tolist():
        low = chr(p).lower()
        if len(low) == 1:
            small[p] = ord(low)
    return member, mixed((small + np.uint64(1)) * np.uint64(_BASE)) | np.uint64(1)


def text_points(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after the other, and where each begins (one more for the end). Null is empty;
    bytes that are no UTF-8 count as the replacement character."""
    data, offsets = text_bytes(array)
    try:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    except UnicodeDecodeError:
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        return points, np.cumsum([0, *map(len, texts)])
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return points, before[offsets]


class Powers:
    """Powers of the hash base and of its inverse, as far as they have been needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, SLICE_BYTES + 1)
            self.up, self.down = _running_product(_BASE, size), _running_product(_INVERSE, size)
        return self.up[:n], self.down[:n]


def _running_product(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers; different numbers stay different."""
    values = values ^ (values >> np.uint64(30))
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def chained(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One hash for an ordered pair of hashes."""
    return mixed(left * np.uint64(0xD6E8FEB86659FD93) + right + np.uint64(0x2545F4914F6CDD1D))


class Words:
    """The words of a slice of texts: byte spans, lower-cased hashes and the text each belongs to."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray, powers: Powers,
                 codes: np.ndarray):
        inside = member[data]
        n = len(data)
        opens, closes = inside.copy(), inside.copy()
        if n:
            follows = np.empty(n, bool)
            follows[0], follows[1:] = False, inside[:-1]
            precedes = np.empty(n, bool)
            precedes[-1], precedes[:-1] = False, inside[1:]
            first = offsets[:-1][offsets[:-1] < offsets[1:]]
            last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
            follows[first], precedes[last] = False, False
            opens &= ~follows
            closes &= ~precedes
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        # border[i]:border[i + 1] are the words of text i
        self.border = np.searchsorted(self.start, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.border))
        up, down = powers.upto(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(codes[data] * up[:n], out=total[1:])
        self.hash = mixed((total[self.end] - total[self.start]) * down[self.start])

    def __len__(self) -> int:
        return len(self.start)
