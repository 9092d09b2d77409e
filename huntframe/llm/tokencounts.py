"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton enumerates all vocabulary pieces that end at each character; dynamic programming
carries the best score and the number of its pieces along. Ties follow the tokenizers and sentencepiece
libraries: of equally good ways to reach a character the one whose last piece starts earliest stays.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntframe.llm.share import Shared
from huntframe.llm.text import text_slices

KEPT_CHUNKS = 300_000
KEPT_LENGTH = 64
UNKNOWN_PENALTY = 10.0  # fixed by the libraries: an unknown character scores so much below the worst piece
BLANK = "▁"  # stands for a blank in the pieces


def read_pieces(model_file: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return {model.id_to_piece(i): model.get_score(i) for i in range(len(model))
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}


class Counter:
    """Counts pieces and sums their scores. Unknown characters count as their UTF-8 bytes."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        # Blanks only lead pieces, so no piece goes across the start of a blank after another character;
        # and none goes across a line end if no piece holds one.
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces):
            raise ValueError("a piece with a blank inside or a line end; such vocabularies are not supported")
        self.cut = regex.compile(" +[^ \n]*|\n[^ \n]*|[^ \n]+")
        self.known: dict[str, tuple[int, float]] = {}

    def best(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best way through a text whose blanks are already replaced."""
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        ended: list = [()] * n
        for end, found in self.automaton.iter(text):
            ended[end] = (*ended[end], found)
        for end in range(1, n + 1):
            top, pieces, single = None, 0, False
            for length, worth in sorted(ended[end - 1], reverse=True):
                single = single or length == 1
                reached = score[end - length] + worth
                if top is None or reached > top:
                    top, pieces = reached, count[end - length] + 1
            if not single:
                reached = score[end - 1] + self.unknown
                if top is None or reached > top:
                    top, pieces = reached, count[end - 1] + len(text[end - 1].encode())
            score[end], count[end] = top, pieces
        return count[n], score[n]

    def _learn(self, chunks) -> None:
        for chunk in chunks:
            if chunk not in self.known:
                self.known[chunk] = self.best(chunk.replace(" ", BLANK))

    def totals(self, texts: list[str]) -> list[tuple[int, float]]:
        """(pieces, score) of whole texts; a text gets a leading blank, the empty text has no pieces."""
        if len(self.known) > KEPT_CHUNKS:
            self.known = {}
        cut = []
        for text in texts:
            led = " " + text.replace(BLANK, " ")
            # a line end starts a chunk; what follows a single blank is led by it
            plain = led.replace("\n", " \n").split(" ")[1:]
            if "" in plain:
                cut.append(self.cut.findall(led) if text else [])
            else:
                cut.append([c if c[0] == "\n" else " " + c for c in plain])
        different = {c for chunks in cut for c in chunks}
        new = sorted(different.difference(self.known))
        self._learn(new)
        out = []
        for chunks in cut:
            found = [self.known[c] for c in chunks]
            out.append((sum([f[0] for f in found]), sum([f[1] for f in found])))
        for chunk in new:
            if len(chunk) > KEPT_LENGTH:
                del self.known[chunk]
        return out


def count_tokens(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """Adds ``n_tokens`` and ``token_score`` (sum of the pieces' scores), replacing columns of these names.

    Null and empty texts have none. Each row is counted on its own, whole, whatever its length.
    """
    docs = docs.drop("n_tokens", "token_score")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("token_score", T.DoubleType())])
    pieces = Shared(docs.sparkSession, read_pieces(model_file))

    def run(batches):
        counter = Counter(pieces.value)
        for batch in text_slices(batches, text):
            found = counter.totals([t or "" for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())],
                names=[*batch.schema.names, "n_tokens", "token_score"])

    return docs.mapInArrow(run, schema)
