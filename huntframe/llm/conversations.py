"""Repair of conversations: the cheapest edits after which roles alternate and no row is empty or repeated.

Edits are chosen by dynamic programming over the rows. Each state keeps its cheapest audit (the initials of the edits
so far) as a node linked to the node before, so that audits share their beginnings. Of two audits of one cost the
first in ASCII order wins; where they part is found by their rolling hashes at binary-lifted ancestors.

Rows are sorted over all partitions at once, so a conversation of any length may lie in many tasks. A task sums up
its piece of such a conversation as the cheapest audit from each state to each state; the pieces of one conversation
are then put together by the same dynamic programming, a piece at a time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE_ROWS = 4096
PIECE_CHARACTERS = 1 << 20

#: States: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Edits that make the last row one of the assistant: from each state the cost and the initials.
_ENDINGS = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}


def _kept(initial: str, state: int) -> int | None:
    """The state after a row that keeps its role, None where it must not stand."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def _steps(initial: str, truncated: bool) -> list[list[tuple[int, int, str]]]:
    """For each state after a row: (state before, cost, initials). Rows are inserted before a row that stays; before
    a deleted one they would only come later in ASCII order."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for before in range(4):
        ways = [(before, DELETE, "D")]
        state, inserted = before, 0
        while inserted < 3:
            stays = inserted * INSERT + TRUNCATED * truncated
            ways.append((_NEXT[state], stays + REROLE, "I" * inserted + "R"))
            after = _kept(initial, state)
            if after is not None:
                ways.append((after, stays + KEEP, "I" * inserted + "K"))
            state, inserted = _NEXT[state], inserted + 1
        for after, cost, label in ways:
            best[before, after] = min(best.get((before, after), (cost, label)), (cost, label))
    return [[(b, *best[b, after]) for b in range(4) if (b, after) in best] for after in range(4)]


_STEPS = {(i, t): _steps(i, t) for i in ("s", "u", "a", "") for t in (False, True)}


class Audits:
    """Audits as linked nodes. Nodes of one depth stand for the same rows."""

    MODULUS = (1 << 64) - 59

    def __init__(self):
        self.label, self.hash, self.up = [""], [0], [()]

    def longer(self, node: int, label: str) -> int:
        data = label.encode("ascii")
        self.label.append(label)
        self.hash.append((self.hash[node] * pow(256, len(data), self.MODULUS) + int.from_bytes(data, "big")) % self.MODULUS)
        ancestors, at, j = [node], node, 0  # one label, two, four, ... before
        while j < len(self.up[at]):
            at = self.up[at][j]
            ancestors.append(at)
            j += 1
        self.up.append(tuple(ancestors))
        return len(self.label) - 1

    def first(self, a: int, b: int) -> bool:
        """Whether the audit ``a`` comes before the different audit ``b`` of the same depth."""
        x, y = a, b
        for j in range(len(self.up[a]) - 1, -1, -1):
            if j < len(self.up[x]) and self.hash[self.up[x][j]] != self.hash[self.up[y][j]]:
                x, y = self.up[x][j], self.up[y][j]
        if self.up[x][0] == self.up[y][0] and self.label[x] != self.label[y]:
            return self.label[x] < self.label[y]
        return self.text(a) < self.text(b)  # equal hashes of different audits

    def labels(self, node: int) -> list[str]:
        out = []
        while node:
            out.append(self.label[node])
            node = self.up[node][0]
        return out[::-1]

    def text(self, node: int) -> str:
        return "".join(self.labels(node))


def _step(audits: Audits, now: list, ways: list[list[tuple[int, int, str]]]) -> list:
    """The cheapest (cost, node) of each state after one more row or piece."""
    after = []
    for options in ways:
        best = None
        for before, cost, label in options:
            if now[before] is None:
                continue
            total, node = now[before][0] + cost, now[before][1]
            if best is None or total < best[0] or (total == best[0] and (
                    label < best[2] if node == best[1] else audits.first(node, best[1]))):
                best = (total, node, label)
        after.append(best and (best[0], audits.longer(best[1], best[2])))
    return after


def _ended(audits: Audits, now: list) -> tuple[int, int, str]:
    """Cost, node and last initials of the cheapest whole audit."""
    best = None
    for state, (cost, label) in _ENDINGS.items():
        if now[state] is None:
            continue
        total, node = now[state][0] + cost, now[state][1]
        if best is None or total < best[0] or (total == best[0] and audits.first(node, best[1])):
            best = (total, node, label)
    return best


@dataclass
class Piece:
    """Rows of one conversation that follow each other."""

    rows: list = field(default_factory=list)  # (role, text, number of rows, whether they must go)
    steps: list = field(default_factory=list)
    size: int = 0
    faults: dict = field(default_factory=lambda: {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0})
    initials: list = field(default_factory=list)  # of the first and the last row
    turns: list = field(default_factory=list)  # first, last, number of different ones

    def add(self, turn: int | None, role: str, text: str, copies: int, seen: bool) -> None:
        worded = text.strip(_BLANKS)
        if turn is not None:
            if not self.turns:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns[1:] = [turn, self.turns[2] + 1]
        initial = role[:1]
        self._follow(initial, copies)
        if not worded:
            self._fault("blank", copies, role)
        elif seen:
            self._fault("duplicate", copies, role)
        else:
            cut = worded[-1] not in ".!?"
            self.faults["truncated"] += cut
            self.rows.append((role, text, 1, False))
            self.steps.append(_STEPS[initial if initial in ("s", "u", "a") else "", cut])
            self.size += len(text)
            if copies > 1:
                self._fault("duplicate", copies - 1, role)

    def _follow(self, initial: str, copies: int) -> None:
        if self.initials:
            self.faults["illegal"] += self.initials[1] + initial not in ("su", "ua", "au")
            self.initials[1] = initial
        else:
            self.initials = [initial, initial]
        self.faults["illegal"] += copies - 1

    def _fault(self, name: str, copies: int, role: str) -> None:
        self.faults[name] += copies
        self.rows.append((role, "", copies, True))
        self.steps.append([[(s, DELETE * copies, "D" * copies)] for s in range(4)])

    def ways(self, before: int) -> tuple[Audits, list]:
        audits = Audits()
        now = [(0, 0) if s == before else None for s in range(4)]
        for ways in self.steps:
            now = _step(audits, now, ways)
        return audits, now

    def summary(self) -> dict:
        """All that is needed of this piece to put the conversation together, but for the texts."""
        ways: list[list] = [[] for _ in range(4)]
        for before in range(4):
            audits, now = self.ways(before)
            for after, best in enumerate(now):
                if best:
                    ways[after].append((before, best[0], audits.text(best[1])))
        return {**self.counts(), "ways": ways}

    def counts(self) -> dict:
        return {"faults": self.faults, "initials": self.initials, "turns": self.turns}


def repaired_rows(rows: list, audit: str, state: int) -> Iterator[tuple[str, str]]:
    """(role, text) of the rows that an audit leaves, from the state before."""
    at = left = 0
    for edit in audit:
        if edit == "I":
            state = _NEXT[state]
            yield _ROLE[state], ""
            continue
        if not left:
            role, text, left, _ = rows[at]
            at += 1
        left -= 1
        if edit == "K":
            state = _kept(role[:1], state)
            yield role, text
        elif edit == "R":
            state = _NEXT[state]
            yield _ROLE[state], text


def _state_after(rows: list, audit: str, state: int) -> int:
    for role, _ in repaired_rows(rows, audit, state):
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
    return state


def _report(summaries: list[dict], cost: int, audit: str) -> dict:
    """Faults, gaps and audit of a conversation from its pieces, in order."""
    faults = {k: sum(s["faults"][k] for s in summaries) for k in ("blank", "duplicate", "truncated", "illegal")}
    worded = [s for s in summaries if s["initials"]]
    faults["illegal"] += sum(a["initials"][1] + b["initials"][0] not in ("su", "ua", "au") for a, b in zip(worded, worded[1:]))
    turns = [s["turns"] for s in summaries if s["turns"]]
    different = sum(t[2] for t in turns) - sum(a[1] == b[0] for a, b in zip(turns, turns[1:]))
    gaps = turns[-1][1] - turns[0][0] + 1 - different if turns else 0
    return {"gaps": gaps, **faults, "cost": cost, "audit": audit}


class _Text:
    """Repaired rows as text, part by part, and the digest of the whole."""

    def __init__(self):
        self.digest, self.begun = hashlib.sha256(), False

    def part(self, rows) -> str:
        text = "\n".join(f"{role}:{text}" for role, text in rows)
        some = text if rows and not self.begun else "\n" + text if rows else ""
        self.begun = self.begun or bool(rows)
        self.digest.update(some.encode("utf-8", "surrogatepass"))
        return some


def _rows_of(batches, names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names])


def _summed_up(batches, conv_type, texts: bool) -> Iterator[pa.RecordBatch]:
    """Rows of one partition as finished conversations, and as pieces of those that may go on in another one."""
    out: list[tuple] = []
    held = 0
    names = ["conv", "turn", "role", "head", "mark", "text", "copies", "later"]

    def batch():
        columns = list(zip(*out)) if out else [[]] * len(_PIECES)
        types = [conv_type, pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_PIECES)

    def give(conv, at, piece: Piece, alone: bool):
        nonlocal held
        if alone:
            audits, now = piece.ways(START)
            cost, node, ending = _ended(audits, now)
            audit = audits.text(node) + ending
            text = _Text()
            repaired = text.part(list(repaired_rows(piece.rows, audit, START)))
            body = _report([piece.counts()], cost, audit)
            body["repaired_sha256"] = text.digest.hexdigest()
            out.append((conv, 2, *at, json.dumps(body), repaired if texts else None))
            held += len(repaired) if texts else 0
        else:
            out.append((conv, 0, *at, json.dumps(piece.summary()), None))
            out.append((conv, 1, *at, json.dumps(piece.rows), None))
            held += piece.size + 16 * len(piece.rows)

    waiting = None  # the last conversation so far: it is not known yet whether it ends here
    first = True
    for conv, rows in groupby(_rows_of(batches, names), lambda r: r[0]):
        if waiting:
            give(*waiting)
            waiting = None
        piece, at, alone, noted = Piece(), None, not first, None
        first = False
        for _, turn, role, head, mark, text, copies, later in rows:
            at = at or (turn, role, head, mark)
            if later:  # the row itself is next
                noted = mark
                continue
            if copies:
                piece.add(turn, role, text, copies, mark == noted)
            noted = None
            if len(piece.rows) >= PIECE_ROWS or piece.size >= PIECE_CHARACTERS:
                alone = False
                give(conv, at, piece, False)
                piece, at = Piece(), None
            if held >= 8 * PIECE_CHARACTERS or len(out) >= 8192:
                yield batch()
                out.clear()
                held = 0
        if at is not None:
            waiting = (conv, at, piece, alone)
    if waiting:
        give(*waiting[:3], False)
    yield batch()


_PIECES = ["conv", "kind", "turn", "role", "head", "mark", "body", "repaired"]
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_RESULT = ["part", "last", *_COUNTS, "audit", "repaired", "repaired_sha256"]


def _put_together(batches, conv_type, conv: str, texts: bool) -> Iterator[pa.RecordBatch]:
    types = [conv_type, pa.int64(), pa.bool_(), *[pa.int64()] * len(_COUNTS), pa.string(), pa.string(), pa.string()]
    out: list[tuple] = []
    held = 0

    def batch():
        columns = list(zip(*out)) if out else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[conv, *_RESULT])

    def last_row(name, part, report, repaired, digest):
        return (name, part, True, *[report[c] for c in _COUNTS], report["audit"], repaired, digest)

    for name, rows in groupby(_rows_of(batches, ["conv", "kind", "body", "repaired"]), lambda r: r[0]):
        summaries, audits, now = [], Audits(), [(0, 0), None, None, None]
        path = None
        for _, kind, body, repaired in rows:
            body = json.loads(body)
            if kind == 2:
                out.append(last_row(name, 0, body, repaired, body["repaired_sha256"]))
                held += len(repaired or "")
            elif kind == 0:
                now = _step(audits, now, body.pop("ways"))
                summaries.append(body)
            else:
                if path is None:
                    cost, node, ending = _ended(audits, now)
                    path = audits.labels(node)
                    path[-1] += ending
                    report, part, state, text = _report(summaries, cost, "".join(path)), 0, START, _Text()
                some = text.part(list(repaired_rows(body, path[part], state)))
                state = _state_after(body, path[part], state)
                part += 1
                if part < len(path):
                    if texts:
                        out.append((name, part - 1, False, *[None] * len(_COUNTS), None, some, None))
                else:
                    out.append(last_row(name, part - 1, report, some if texts else None, text.digest.hexdigest()))
                held += len(some) if texts else 0
            if held >= 8 * PIECE_CHARACTERS or len(out) >= 8192:
                yield batch()
                out.clear()
                held = 0
    yield batch()


def damage(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """Conversations with faults: by the remainder by 20 of crc32(``conv:turn``) a row is left out (0), emptied (1), loses
    its ``.!?`` (2), stands twice (3) or becomes the user's (4). Nulls count as one space. The column ``copies`` says
    how often a row stands there, 0 for a row that is left out."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(f"`{conv}`").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col(f"`{turn}`").cast("string"), space))
    what = F.crc32(key.cast("binary")) % 20
    said = F.coalesce(F.col(f"`{text}`").cast("string"), space)
    return conversations.select(
        F.col(f"`{conv}`"), F.col(f"`{turn}`"),
        F.when(what == 4, "user").otherwise(F.coalesce(F.col(f"`{role}`").cast("string"), space)).alias(role),
        F.when(what == 1, "").when(what == 2, F.translate(said, ".!?", "")).otherwise(said).alias(text),
        F.when(what == 0, 0).when(what == 3, 2).otherwise(1).alias("copies"))


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           copies: str | None = None, texts: bool = True) -> DataFrame:
    """The cheapest repair of each conversation.

    A conversation's rows stand in the order of turn (nulls first), role, the first 32 characters of the text and its
    digest; ``copies`` names a column with the number of times a row stands there (1 without it, also where it is null;
    a conversation whose rows all have 0 is reported as empty). A row's first fault counts: ``blank`` (no character but
    white space), ``duplicate`` (role and text of an earlier row), ``truncated`` (does not end in ``.!?``). Rows are
    kept (K, costs 0), get the role user or assistant (R, 2) or are deleted (D, 3; blank and duplicate rows must be),
    empty ones of user or assistant are inserted (I, 2); a truncated row that stays costs 1. The roles that result are
    nothing, or pairs of user and assistant, a system row before them at most. Roles count by their first letter; a row
    of another role, an empty one included, cannot be kept as it is. Of audits of one cost the first in ASCII order wins.

    Returns per conversation, the one of a null id included, ``gaps`` (missing turns between the smallest and largest),
    the counts of faults, ``illegal`` (neighbours other than system-user, user-assistant, assistant-user), ``cost``,
    ``audit`` and ``repaired_sha256`` on the row with ``last``. ``repaired`` holds the rows as ``role:text`` lines; a
    conversation of more than PIECE_ROWS rows or PIECE_CHARACTERS characters, or one that lay in two tasks, may come
    in several parts, of which the texts follow each other. Without ``texts`` only last parts come, without
    ``repaired``. Nulls in role or text count as one space, turns that are no whole numbers as null. Repeated rows are
    copies; other columns play no part; an empty table gives no rows.
    """
    space = F.lit(" ")
    count = F.coalesce(F.col(f"`{copies}`").cast("long"), F.lit(1)) if copies else F.lit(1).cast("long")
    there = F.col("copies") > 0
    rows = conversations.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), space).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), space).alias("text"), F.greatest(count, F.lit(0)).alias("copies"))
    rows = rows.select("conv", "copies", *[F.when(there, F.col(c)).alias(c) for c in ("turn", "role", "text")])
    # equal rows as one; what is left out as one row per conversation
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    name = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
    rows = rows.select("conv", "turn", "role", F.left("text", F.lit(32)).alias("head"),
                       F.coalesce(F.unhex(F.sha2(F.concat_ws(":", F.length(name), name, F.length("role"), "role", "text").cast(
                           "binary"), 256)), F.lit(b"")).alias("mark"), "text", "copies")
    # which rows have their role and text in an earlier turn: told by notes that are sorted to stand before them
    slim = rows.filter(there).select("conv", "turn", "role", "head", "mark")
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    earliest = slim.groupBy("mark").agg(F.min(when).alias("earliest"), F.count("*").alias("n")).filter("n > 1")
    notes = slim.join(earliest, "mark").filter(when > F.col("earliest")).select(
        *slim.columns, F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), F.lit(True).alias("later"))
    order = ["conv", *[F.col(c).asc_nulls_first() for c in ("turn", "role", "head", "mark")]]
    placed = rows.withColumn("later", F.lit(False)).unionByName(notes)
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order, F.col("later").desc())

    conv_field = T.StructField("conv", rows.schema["conv"].dataType)
    pieces = placed.mapInArrow(
        lambda b: _with_types(b, lambda bs, t: _summed_up(bs, t, texts)),
        T.StructType([conv_field, *T._parse_datatype_string(
            "kind int, turn long, role string, head string, mark binary, body string, repaired string").fields]))
    merged = pieces.repartition("conv").sortWithinPartitions("conv", "kind", *order[1:])
    result = T.StructType([T.StructField(conv, conv_field.dataType), *T._parse_datatype_string(
        "part long, last boolean, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired string, "
        "repaired_sha256 string").fields])
    return merged.mapInArrow(lambda b: _with_types(b, lambda bs, t: _put_together(bs, t, conv, texts)), result)


def _with_types(batches, work):
    """The work on batches, told the Arrow type of the conversation's id; no batch gives none."""
    batches = iter(batches)
    head = next(batches, None)
    if head is not None:
        def whole():
            yield head
            yield from batches

        yield from work(whole(), head.schema.field("conv").type)
