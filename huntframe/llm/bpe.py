"""Byte-pair encoding and decoding with a pair occurrence index.

A slice of texts is cut into pieces, the different new pieces are laid out in one array of symbols, and
an index maps each mergeable pair to all its positions in that array. Ranks are then applied in ascending
order: a merge visits the positions of its pair from left to right and updates only the lists of the pairs
it creates. Every piece thereby ends exactly as if it had been merged on its own.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntframe.llm.text import Remembered, text_slices

VOCABULARY_BYTES = 64 << 20  # a larger tokenizer file is refused, for it is sent to every task
KEPT_CHUNKS = 150_000  # of each of the two generations of chunks (and of pieces) that a task remembers
KEPT_LENGTH = 64
BATCH_BYTES = 2 << 20  # of text that share one index

#: How byte-level tokenizers cut text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BytePairs:
    """The merges of one tokenizer file of the byte-level kind."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, cut = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or cut["type"] != "ByteLevel" or spec["normalizer"] or cut["add_prefix_space"]:
            raise ValueError("expected byte-level BPE without normalizer or added space")
        letters = byte_letters()
        vocabulary = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocabulary.items()}
        self.bytes_of.update({i: s.encode() for s, i in self.special.items()})
        self.first_id = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.first_id[byte] = vocabulary[letter]
        self.merges = []  # by rank: left, right, merged
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges.append((vocabulary[left], vocabulary[right], vocabulary[left + right]))
        self.rank = {(a, b): r for r, (a, b, _) in reversed(list(enumerate(self.merges)))}
        self.size = max(self.bytes_of) + 1
        pairs = np.array([[a * self.size + b, r] for (a, b), r in self.rank.items()], np.int64)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.pair_keys, self.pair_ranks = pairs[:, 0], pairs[:, 1]

    def index(self, symbols: np.ndarray, last: np.ndarray) -> dict[int, list[int]]:
        """For each rank, the positions at which its pair stands; ``last`` marks the ends of pieces."""
        keys = symbols[:-1] * self.size + symbols[1:]
        found = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        places = np.flatnonzero((self.pair_keys[found] == keys) & ~last[:-1])
        ranks = self.pair_ranks[found[places]]
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        return {int(r[0]): p.tolist() for r, p in zip(np.split(ranks, cuts), np.split(places, cuts)) if len(r)}

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece (none is empty), as little-endian unsigned 32-bit integers."""
        if not pieces:
            return []
        ends = np.cumsum([len(p) for p in pieces])
        flat = self.first_id[np.frombuffer(b"".join(pieces), np.uint8)]
        last = np.zeros(len(flat), bool)
        last[ends - 1] = True
        places = self.index(flat, last)
        following, preceding = np.arange(1, len(flat) + 1), np.arange(-1, len(flat) - 1)
        following[last], preceding[ends[:-1]] = -1, -1
        symbol = flat.tolist()
        self._apply(places, symbol, following.tolist(), preceding.tolist(), ends)
        merged = np.array(symbol)
        alive = merged >= 0
        packed = merged[alive].astype("<u4").tobytes()
        cuts = [0, *(np.cumsum(alive)[ends - 1] * 4).tolist()]
        return [packed[i:j] for i, j in zip(cuts, cuts[1:])]

    def _apply(self, places, symbol, following, preceding, ends) -> None:
        rank_of, merges = self.rank.get, self.merges
        active = list(places)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            waiting = places.pop(rank, None)
            if waiting is None:
                continue
            left, right, merged = merges[rank]
            waiting.sort()
            held = -1  # end of a piece in which a lower rank has turned up and must come first
            for at in waiting:
                if symbol[at] != left:
                    continue
                after = following[at]
                if after < 0 or symbol[after] != right:
                    continue
                if at < held:
                    places.setdefault(rank, []).append(at)
                    continue
                beyond, before = following[after], preceding[at]
                symbol[at], symbol[after], following[at] = merged, -1, beyond
                if beyond >= 0:
                    preceding[beyond] = at
                    new = rank_of((merged, symbol[beyond]))
                    if new is not None:
                        if new in places:
                            places[new].append(at)
                        else:
                            places[new] = [at]
                            heapq.heappush(active, new)
                        if new < rank:
                            held = int(ends[np.searchsorted(ends, at, "right")])
                if before >= 0:
                    new = rank_of((symbol[before], merged))
                    if new is not None:
                        if new in places:
                            places[new].append(before)
                        else:
                            places[new] = [before]
                            heapq.heappush(active, new)
                        if new < rank:
                            held = int(ends[np.searchsorted(ends, at, "right")])
            if rank in places:
                heapq.heappush(active, rank)


class Encoder:
    """Encodes texts, remembering the chunks it has met.

    A text is cut before its line ends and at its blanks. A single blank or line end between two visible
    characters always starts a new piece, so such chunks can be encoded one by one; a text with any other
    white space is cut by the pattern as a whole.
    """

    def __init__(self, pairs: BytePairs, plain_specials: bool = False):
        self.pairs = pairs
        self.cut = regex.compile(PATTERN)
        self.odd = regex.compile(r"\s").search
        names = [] if plain_specials else sorted(pairs.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.chunks = Remembered()  # by what follows a blank, or by a line end and what follows it
        self.pieces = Remembered()

    def _pieces_of(self, chunk: str) -> list[str] | None:
        """None if the white space in or around the chunk is not plain."""
        if chunk.isascii() and chunk.isalpha():
            return [" " + chunk]
        body = chunk[1:] if chunk[:1] == "\n" else chunk
        if not body or self.odd(body):
            return None
        return self.cut.findall(chunk if chunk[:1] == "\n" else " " + chunk)

    def _encoded(self, different: list[str], kept: bool) -> dict[str, bytes]:
        """The ids of pieces. Long ones are not remembered."""
        new = [p for p in different if p not in self.pieces]
        ids = dict(zip(new, self.pairs.encode_pieces([p.encode() for p in new])))
        if kept:
            self.pieces.update({p: i for p, i in ids.items() if len(p) <= KEPT_LENGTH})
        return ids

    def _learn(self, chunks: list[str]) -> dict[str, bytes | None]:
        cut = {c: self._pieces_of(c) for c in chunks}
        ids = self._encoded(list(dict.fromkeys(p for pieces in cut.values() if pieces for p in pieces)), True)
        known = self.pieces
        return {c: None if pieces is None else b"".join([ids[p] if p in ids else known[p] for p in pieces])
                for c, pieces in cut.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        self.chunks.renew(KEPT_CHUNKS)
        self.pieces.renew(KEPT_CHUNKS)
        parts_of = [self.specials.split(t) if self.specials and "<" in t else [t] for t in texts]
        plain = [p for parts in parts_of for p in parts[::2] if p]
        cut = [p.replace("\n", " \n").split(" ") for p in plain]
        different = set()
        for chunks in cut:
            different.update(chunks[1:])
        learnt = self._learn(self.chunks.missing(different))
        self.chunks.update(learnt)
        known = self.chunks
        heads, bodies, whole = [], [], []
        for text, chunks in zip(plain, cut):
            try:
                bodies.append(b"".join([known[c] for c in chunks[1:]]))
                odd = not chunks[0] or self.odd(chunks[0])
            except TypeError:  # a chunk with other white space
                bodies.append(b"")
                odd = True
            heads.append(self.cut.findall(text if odd else chunks[0]))
            whole.append(odd)
        ids = self._encoded(list(dict.fromkeys(p for pieces in heads for p in pieces)), False)
        for chunk in [c for c in learnt if len(c) > KEPT_LENGTH]:
            del known[chunk]
        pieces = self.pieces
        done = iter([b"".join([ids[p] if p in ids else pieces[p] for p in head]) + (b"" if odd else body)
                     for head, body, odd in zip(heads, bodies, whole)])
        return [b"".join([(next(done) if p else b"") if not i % 2 else np.uint32(self.pairs.special[p]).tobytes()
                          for i, p in enumerate(parts)]) for parts in parts_of]


def read_vocabulary(path: str, most: int = VOCABULARY_BYTES) -> str:
    """The tokenizer file, read once on the driver; its checked size bounds what tasks receive."""
    with open(path, encoding="utf-8") as f:
        content = f.read(most + 1)
    if len(content) > most:
        raise ValueError(f"{path} is larger than {most} characters")
    return content


def encode(df: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None,
           plain_specials: bool = False) -> DataFrame:
    """Adds ``ids`` (binary, little-endian unsigned 32-bit integers) and ``n_tokens``.

    ``keep`` names the columns to carry along, all when not given; a column called ``ids`` or ``n_tokens``
    gives way to the new one. Null and empty texts have no ids. Strings of special tokens in a text become
    those tokens unless ``plain_specials``. Each row is encoded on its own, so repeated rows, an empty
    table and any number of copies need no care; a text of any length is encoded whole.
    """
    carried = [c for c in (df.columns if keep is None else keep) if c not in ("ids", "n_tokens")]
    source = df.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text}`").alias("_text"))
    kept = T.StructType([f for f in source.schema.fields if f.name in carried])
    schema = T.StructType([*kept.fields, T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
    content = df.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer))

    def run(batches):
        encoder = Encoder(BytePairs(content.value), plain_specials)
        for batch in text_slices(batches, "_text", BATCH_BYTES):
            ids = encoder.encode([t or "" for t in batch.column("_text").to_pylist()])
            columns = [batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())],
                names=[*carried, "ids", "n_tokens"])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", to: str = "text",
           keep: list[str] | None = None) -> DataFrame:
    """Turns ids back into text, special tokens included. Bytes that are no UTF-8 become U+FFFD; null ids
    give the empty text. ``to`` replaces a column of that name."""
    carried = [c for c in (df.columns if keep is None else keep) if c != to]
    source = df.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{ids}`").alias("_ids"))
    kept = T.StructType([f for f in source.schema.fields if f.name in carried])
    schema = T.StructType([*kept.fields, T.StructField(to, T.StringType())])
    content = df.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer))

    def run(batches):
        known = BytePairs(content.value).bytes_of
        for batch in text_slices(batches, "_ids"):
            texts = [b"".join([known[i] for i in np.frombuffer(packed or b"", "<u4").tolist()]).decode("utf-8", "replace")
                     for packed in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carried], pa.array(texts, pa.string())], names=[*carried, to])

    return source.mapInArrow(run, schema)
