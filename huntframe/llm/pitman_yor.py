"""A hierarchical Pitman-Yor language model of word pairs.

Each word is the context restaurant of the words that follow it; all context restaurants share one parent, the
root restaurant, whose base is uniform over the known words and one unknown word. Seatings are summed up by
the number of tables per dish. Gibbs sweeps draw it for every pair from its conditional distribution, which takes
in all seatings of that number (generalised Stirling numbers), given the tables that the sweep before left to the
context's other pairs, and the root's predictive probability without the pair's own tables. What sits at the tables of
all contexts are the root's customers, whose tables are drawn likewise in each sweep. The probability of a word is the
average of its predictive probabilities over the sweeps after the burn-in.

Shards of documents send their different pairs with local counts; one shard speaks for each pair and draws its tables.
The tables of a sweep are stored in the shared folder. Ranges of words add them up and answer the shards.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntframe.llm import shards
from huntframe.llm.shards import unpacked
from huntframe.llm.text import SPACED, Powers, Words, byte_codes, chained, text_bytes, text_slices
from huntframe.session import scratch_path, store

BURN_IN = 5  # sweeps that are not averaged
DRAWS = 4  # sweeps after these, which are
SHARD_BYTES = 12 << 20  # of text; larger shards send fewer of their words and pairs twice
PAIR_DISCOUNT, PAIR_STRENGTH = 0.85, 1.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.6, 10.0
EXACT_CUSTOMERS = 256  # of a dish; beyond, its tables follow the limit for many customers
END, START = np.uint64(3), np.uint64(5)  # the token after, and the context before, a text
_SPEAKS, _SHARED = 1, 2  # what a shard is told of a pair: it speaks for it, other shards have it as well
_NAMES = ["kind", "bucket", "shard", "parts", "a", "b"]
_ROW = "kind string, bucket int, shard long, parts array<binary>, a long, b long"


# ---------------------------------------------------------------- seating


def stirling_logs(discount: float, most: int = EXACT_CUSTOMERS) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: ways to seat c customers of a dish at t tables."""
    logs = np.full((most + 1, most + 1), -np.inf)
    logs[0, 0] = 0.0
    for c in range(most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            logs[c + 1, 1:c + 2] = np.logaddexp(logs[c, t - 1], logs[c, t] + np.log(np.maximum(c - t * discount, 1e-300)))
    return logs


def drawn_tables(customers: np.ndarray, parent: np.ndarray, others: np.ndarray, discount: float, strength: float,
                 stirling: np.ndarray, rng: np.random.Generator, limit: bool = False) -> np.ndarray:
    """The number of tables of each dish: one Gibbs draw given the customers, the parent's probability of the
    dish and the tables of the restaurant's other dishes.

    Beyond EXACT_CUSTOMERS a dish's customers are seated in blocks, without regard to how likely those that follow are to
    sit there, which opens too many tables. With ``limit`` they follow the distribution's limit for many customers.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    for c in np.unique(customers[(customers > 1) & (customers <= EXACT_CUSTOMERS)]).tolist():
        rows = np.flatnonzero(customers == c)
        step = np.arange(c)
        weight = np.log(parent[rows])[:, None] + np.log(strength + discount * (others[rows][:, None] + step))
        logs = np.cumsum(weight, axis=1) + stirling[c, 1:c + 1]
        p = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
        tables[rows] = (p < rng.random(len(rows))[:, None] * p[:, -1:]).sum(axis=1) + 1
    rows = np.flatnonzero(customers > EXACT_CUSTOMERS)
    if limit:
        # the Stirling numbers go like 1 / (discount ** t * (t - 1)!), which leaves a negative binomial distribution
        more = rng.negative_binomial(strength / discount + others[rows] + 1, 1 - np.minimum(parent[rows], 0.999))
        tables[rows] = np.minimum(1 + more, customers[rows])
        return tables
    seated = np.ones(len(rows), np.int64)
    while len(rows):
        t = tables[rows]
        block = np.minimum(np.maximum(1, seated // 32), customers[rows] - seated)
        opens = (strength + discount * (others[rows] + t)) * parent[rows]
        tables[rows] = t + rng.binomial(block, opens / (seated - discount * t + opens))
        seated = seated + block
        going = seated < customers[rows]
        rows, seated = rows[going], seated[going]
    return tables


def root_probability(customers, tables, all_customers, all_tables, vocabulary_size: int) -> np.ndarray:
    """The root's predictive probability of words, over the known words and one unknown."""
    base = (ROOT_STRENGTH + ROOT_DISCOUNT * all_tables) / (vocabulary_size + 1)
    return (np.maximum(customers - ROOT_DISCOUNT * tables, 0) + base) / (ROOT_STRENGTH + all_customers)


# ---------------------------------------------------------------- tokens of a shard


class Tokens:
    """The tokens of a shard's texts, each text closed by an end token, and their different words and pairs."""

    def __init__(self, table: pa.Table, powers: Powers, text: str = "_text"):
        codes, words, sizes = byte_codes(), [], []
        for batch in text_slices(table.combine_chunks().to_batches(), text):
            found = Words(*text_bytes(batch.column(text)), SPACED, powers, codes)
            words.append(np.insert(found.hash, found.border[1:], END))
            sizes.append(np.diff(found.border) + 1)
        self.token = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.border = np.concatenate([[0], np.cumsum(self.size)])
        learns = table["_learn"].to_numpy(zero_copy_only=False).astype(bool) if table.num_rows else np.zeros(0, bool)
        self.learns = np.repeat(learns, self.size)
        # START is one of the words, as a context
        words = np.append(self.token, START)
        order, first, number = _grouped(words)
        self.words, self.word, start = words[order[first]], number[:-1], number[-1]
        self.context = np.empty(len(self.token), np.int64)
        if len(self.token):
            self.context[1:] = self.word[:-1]
            self.context[self.border[:-1]] = start
        self.counts = np.bincount(self.word[self.learns], minlength=len(self.words))
        self.counts[start] = int(learns.sum())

    def find_pairs(self) -> None:
        keys = chained(self.words[self.context], self.token)
        order, first, self.pair = _grouped(keys)
        first = order[first]
        self.pairs = keys[first]
        self.pair_context, self.pair_word = self.context[first], self.word[first]
        self.pair_counts = np.bincount(self.pair[self.learns], minlength=len(self.pairs))


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first place of each different key in that order, number of the different key of each row)."""
    order = np.argsort(keys)
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


def _ranked(keys: np.ndarray, buckets: int, steps: np.ndarray) -> np.ndarray:
    """Numbers that stand for a shard's sorted keys in what is sent later: they fall into the same buckets and hold the
    rank there, so that their differences are small. ``steps`` are those of the ranks, anew in each bucket."""
    place = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    begins, steps = np.flatnonzero(np.diff(place.astype(np.int64), prepend=-1)), steps.astype(np.uint64)
    upto = np.cumsum(steps, dtype=np.uint64)
    rank = upto - np.repeat(upto[begins] - steps[begins], np.diff(np.append(begins, len(keys))))
    low = ((place << np.uint64(32)) + np.uint64(buckets - 1)) // np.uint64(buckets)
    return (low << np.uint64(32)) | rank


# ---------------------------------------------------------------- the operator


def score(docs: DataFrame, learn, name: str = "doc_id", text: str = "text", draws: int = DRAWS,
          shard_bytes: int = SHARD_BYTES, burn_in: int = BURN_IN) -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score, learning from the rows where ``learn`` holds.

    Words are what stands between ASCII white space, in small ASCII letters; each text ends with one more token, so
    null and empty texts have one. ``base_score`` is the log10 probability under add-one word frequencies,
    ``score`` that under the model. Where ``learn`` is null a row is not learnt from. Repeated rows are learnt from as
    often as they stand there. Without any row to learn from, both scores are those of one unknown word per token.
    Columns with the new names are replaced.
    """
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    carried = [c for c in docs.columns if c not in new]
    source = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carried, text])], F.coalesce(learn, F.lit(False)).alias("_learn"))
    count = shards.shard_count(docs, text, shard_bytes)
    train = _train_tokens(source, text)
    texts = shards.sharded(source, count, text, shard_bytes)
    grouped = texts.groupBy("shard")
    stirling = [stirling_logs(d).tolist() for d in (PAIR_DISCOUNT, ROOT_DISCOUNT)]

    stored = _Stored(docs.sparkSession)

    # 1. pairs: counts over all shards; one shard of those that have a pair speaks for it
    def ask_pairs(table: pa.Table) -> pa.Table:
        tokens = Tokens(shards.opened(table), Powers(), text)
        tokens.find_pairs()
        return shards.runs(table["shard"][0].as_py(), count, tokens.pairs, n=tokens.pair_counts.astype(np.uint32))

    def count_pairs(keys, rows, arrays):
        order, first, number = _grouped(keys)
        total = np.add.reduceat(arrays["n"][order].astype(np.int64), first)
        shared = np.diff(np.append(first, len(keys))) > 1
        speaks = np.zeros(len(keys), bool)
        speaks[order[first]] = True
        steps, begins = np.diff(number, prepend=0), np.flatnonzero(np.diff(rows, prepend=-1))
        steps[begins] = number[begins]
        return np.column_stack([total[number], _SPEAKS * speaks + _SHARED * shared[number], steps]).astype(np.uint32)

    pairs_asked = grouped.applyInArrow(shards.releasing(ask_pairs), "bucket int, shard long, keys binary, n binary")
    pairs = shards.answered(pairs_asked, {"n": np.uint32}, count_pairs)

    # 2. what stays: pairs seen once have one table; those seen more often are kept to be drawn
    def start(table: pa.Table, answers: pa.Table) -> pa.Table:
        tokens, shard = Tokens(shards.opened(table), Powers(), text), table["shard"][0].as_py()
        tokens.find_pairs()
        total, flags, steps = shards.answers_of(answers, np.uint32).reshape(-1, 3).T
        own, shared = flags & _SPEAKS > 0, (flags & _SHARED > 0) & (total > 1)
        once, drawn = own & (total == 1), own & (total > 1)
        contexts, words = (np.bincount(side[once], minlength=len(tokens.words)).astype(np.uint32)
                           for side in (tokens.pair_context, tokens.pair_word))
        said = shards.runs(shard, count, tokens.words, n=tokens.counts.astype(np.uint32), contexts=contexts, words=words)
        sides = np.concatenate([tokens.pair_context[drawn], tokens.pair_word[drawn]])
        active, place = np.unique(sides, return_inverse=True)
        context, word = np.split(place.ravel().astype(np.uint32), 2)
        return pa.concat_tables([
            _messages("words", said),
            _row("shard", -1, shard, shards.packed_keys(tokens.words[active]), *map(shards.packed, (context, word, total[drawn]))),
            _row("common", -1, shard, shards.packed_keys(_ranked(tokens.pairs, count, steps)[shared]), shards.packed(own[shared]), shards.packed(shared[drawn])),
            _row("pairs", -1, shard, shards.packed(total), shards.packed(flags.astype(np.uint8)))])

    def gather(table: pa.Table) -> pa.Table:
        keys, arrays = _said(table, np.uint32, np.uint32, np.uint32)
        order, first, _ = _grouped(keys)
        keys = keys[order[first]]
        n, contexts, words = (np.add.reduceat(a[order].astype(np.uint64), first) for a in arrays)
        return _row("bucket", table["bucket"][0].as_py(), -1, shards.packed_keys(keys), *map(shards.packed, (n, contexts, words)),
                    a=int((n[keys != START] > 0).sum()))

    started = stored(grouped.cogroup(shards.by_shard(pairs, count)).applyInArrow(shards.releasing(start), _ROW))
    buckets = stored(started.filter("kind = 'words'").groupBy("bucket").applyInArrow(shards.releasing(gather), _ROW))
    vocabulary_size = buckets.agg(F.sum("a")).first()[0] or 0

    # 3. sweeps: tables per pair given all others and the root, then the root's tables per word
    fixed, totals = started.filter("kind = 'shard'"), [(0, 0)]
    last, seated, kept = fixed.limit(0), buckets.limit(0), []
    for sweep in range(1 + burn_in + draws):
        known = fixed.union(last.filter("kind = 'tables'")).union(seated.filter("kind = 'answer'"))
        work = _seat_pairs(sweep, count, vocabulary_size, *totals[-1], stirling[0])
        last = stored(shards.by_shard(known, count).applyInArrow(shards.releasing(work), _ROW), f"pairs {sweep % 2}")
        known = buckets.union(last.filter("kind = 'said'")).union(seated.filter("kind = 'root'"))
        work = _seat_words(sweep, vocabulary_size, totals[-1][1], stirling[1])
        seated = stored(known.groupBy("bucket").applyInArrow(shards.releasing(work), _ROW), f"words {sweep % 2}")
        totals.append(tuple(x or 0 for x in seated.agg(F.sum("a"), F.sum("b")).first()))
        if sweep > burn_in:
            kept.append((stored(last.filter("kind = 'tables'")), stored(seated.filter("kind = 'root'"))))
    totals = totals[-draws:]
    kept_tables, kept_roots = (reduce(DataFrame.union, x) for x in zip(*kept))

    # 4. scores
    def share(table: pa.Table) -> pa.Table:
        rows = _by_kind(table)
        parts = rows["common"][0][2]
        keys, own, of_drawn = shards.unpacked_keys(parts[0]), unpacked(parts[1], bool), unpacked(parts[2], bool)
        tables = np.zeros((len(keys), draws), np.uint32)
        for d, (_, _, (drawn,)) in enumerate(rows["tables"]):
            tables[own, d] = unpacked(drawn, np.uint32)[of_drawn]
        return shards.runs(table["shard"][0].as_py(), count, keys, tables=tables)

    def told_tables(keys, rows, arrays):
        order, first, number = _grouped(keys)
        return np.maximum.reduceat(arrays["tables"].reshape(-1, draws)[order], first, axis=0)[number]

    shared_asked = shards.by_shard(started.filter("kind = 'common'").union(kept_tables), count).applyInArrow(
        shards.releasing(share), "bucket int, shard long, keys binary, tables binary")
    shared = stored(shards.answered(shared_asked, {"tables": np.uint32}, told_tables))

    def reply(table: pa.Table) -> pa.Table:
        rows = _by_kind(table)
        parts = rows["bucket"][0][2]
        keys, n = shards.unpacked_keys(parts[0]), unpacked(parts[1], np.uint64)
        seats = np.concatenate([unpacked(x, np.uint32).reshape(-1, 3) for _, _, (x,) in rows["root"]], axis=1)
        out = []
        for bucket, shard, asked in rows["words"]:
            at = np.searchsorted(keys, shards.unpacked_keys(asked[0]))
            out.append(_row("answer", bucket, shard, shards.packed(n[at]), shards.packed(seats[at])))
        return pa.concat_tables(out)

    words = started.filter("kind = 'words'").withColumn("parts", F.slice("parts", 1, 1))
    replies = buckets.union(kept_roots).union(words).groupBy("bucket").applyInArrow(
        shards.releasing(reply), _ROW)
    of_shared = shared.select(F.lit("shared").alias("kind"), "bucket", "shard", F.array("answer").alias("parts"),
                              F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    replies = replies.union(of_shared).union(kept_tables).union(started.filter("kind = 'pairs'"))
    schema = T.StructType([*[f for f in source.schema.fields if f.name in carried],
                           *[T.StructField(c, T.LongType()) for c in new[:3]], *[T.StructField(c, T.DoubleType()) for c in new[3:]]])

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        table, rows = shards.opened(table), _by_kind(answers)
        tokens = Tokens(table, Powers(), text)
        tokens.find_pairs()
        n = np.concatenate([unpacked(p[0], np.uint64) for _, _, p in rows["answer"]]).astype(np.int64)
        seats = np.concatenate([unpacked(p[1], np.uint32).reshape(-1, 3 * draws) for _, _, p in rows["answer"]])
        total, flags = (unpacked(x, k) for x, k in zip(rows["pairs"][0][2], (np.uint32, np.uint8)))
        several = total > 1
        drawn, others = (flags & _SPEAKS > 0) & several, flags[(flags & _SHARED > 0) & several] & _SPEAKS == 0
        elsewhere = np.flatnonzero((flags & _SHARED > 0) & several)[others]
        told = np.concatenate([unpacked(p[0], np.uint32).reshape(-1, draws) for _, _, p in rows["shared"]]
                              or [np.zeros((0, draws), np.uint32)])[others]
        probability = np.zeros(len(tokens.pairs))
        context, word = tokens.pair_context, tokens.pair_word
        tables = np.minimum(total, 1)
        for d in range(draws):
            contexts, customers, root_tables = seats[:, 3 * d:3 * d + 3].T
            root = root_probability(customers, root_tables, *totals[d], vocabulary_size)
            tables[drawn], tables[elsewhere] = unpacked(rows["tables"][d][2][0], np.uint32), told[:, d]
            own = np.maximum(total - PAIR_DISCOUNT * tables, 0)
            probability += (own + (PAIR_STRENGTH + PAIR_DISCOUNT * contexts[context]) * root[word]) / (PAIR_STRENGTH + n[context])
        logs = np.log10(probability / draws)[tokens.pair]
        base = np.log10((n + 1.0) / (train + vocabulary_size + 1))[tokens.word]
        border = tokens.border[:-1]
        return schema_table(table, carried, [
            tokens.size, np.add.reduceat((n[tokens.word] > 0).astype(np.int64), border), np.full(len(border), train)],
            [np.add.reduceat(base, border), np.add.reduceat(logs, border)])

    return grouped.cogroup(shards.by_shard(replies, count)).applyInArrow(shards.releasing(finish), schema)


# ---------------------------------------------------------------- sweeps


class _Stored:
    """Tables in the shared folder: a sweep's draws are made once. A named place holds one table at a time; a sweep takes
    those of the sweep before, so two places by turns are enough."""

    def __init__(self, spark):
        self.spark, self.places = spark, {}

    def __call__(self, df: DataFrame, place: str | None = None) -> DataFrame:
        path = scratch_path(self.spark, "seating")
        if place is not None:
            path = self.places.setdefault(place, path)
        store(df, path, "overwrite")
        return self.spark.read.schema(df.schema).parquet(path)


def _row(kind: str, bucket: int, shard: int, *parts: bytes, a: int = 0, b: int = 0) -> pa.Table:
    return pa.table([pa.array([kind]), pa.array([bucket], pa.int32()), pa.array([shard], pa.int64()),
                     pa.array([list(parts)], pa.list_(pa.binary())), pa.array([a], pa.int64()), pa.array([b], pa.int64())], names=_NAMES)


def _messages(kind: str, said: pa.Table) -> pa.Table:
    """Runs of keys with their arrays, as rows of ``_ROW``."""
    n = said.num_rows
    parts = [list(x) for x in zip(*[said[c].to_pylist() for c in said.column_names[2:]])]
    zeros = pa.array(np.zeros(n, np.int64))
    return pa.table([pa.array([kind] * n, pa.string()), said["bucket"], said["shard"], pa.array(parts, pa.list_(pa.binary())),
                     zeros, zeros], names=_NAMES)


def _by_kind(table: pa.Table) -> dict[str, list]:
    """(bucket, shard, parts) of each kind of row, in an order that does not depend on their arrival."""
    table = table.sort_by([("bucket", "ascending"), ("shard", "ascending")])
    rows = defaultdict(list)
    for kind, *row in zip(*[table[c].to_pylist() for c in _NAMES[:4]]):
        rows[kind].append(row)
    return rows


def _said(table: pa.Table, *kinds) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys and arrays of a bucket's messages, concatenated."""
    parts = [row[2] for rows in _by_kind(table).values() for row in rows]
    return (np.concatenate([shards.unpacked_keys(p[0]) for p in parts]),
            [np.concatenate([unpacked(p[1 + i], k) for p in parts]) for i, k in enumerate(kinds)])


def _seat_pairs(sweep: int, count: int, vocabulary_size: int, customers: int, root_tables: int, stirling: list):
    """Draws the tables of the pairs that a shard speaks for; the first sweep gives each pair one."""
    def run(table: pa.Table) -> pa.Table:
        rows = _by_kind(table)
        shard, parts = rows["shard"][0][1:]
        keys, (context, word, total) = shards.unpacked_keys(parts[0]), [unpacked(x, np.uint32) for x in parts[1:4]]
        tables = np.ones(len(total), np.uint32)
        if sweep and len(total):
            own = unpacked(rows["tables"][0][2][0], np.uint32).astype(np.int64)
            seats = np.concatenate([unpacked(p[0], np.uint32) for _, _, p in rows["answer"]]).reshape(-1, 3).astype(np.int64)
            # the root without this pair's customers
            others = seats[word, 1] - own
            left = np.minimum(seats[word, 2], others)
            parent = root_probability(others, left, customers - own, root_tables - seats[word, 2] + left, vocabulary_size)
            rng = np.random.default_rng([sweep, shard])
            tables = drawn_tables(total.astype(np.int64), parent, (seats[context, 0] - own).astype(float), PAIR_DISCOUNT,
                                  PAIR_STRENGTH, np.array(stirling), rng, limit=True).astype(np.uint32)
        contexts, words = (np.bincount(side, tables, len(keys)).astype(np.uint32) for side in (context, word))
        said = shards.runs(shard, count, keys, contexts=contexts, words=words)
        return pa.concat_tables([_messages("said", said), _row("tables", sweep, shard, shards.packed(tables))])

    return run


def _seat_words(sweep: int, vocabulary_size: int, root_tables: int, stirling: list):
    """Adds up a bucket's tables per context and per word, draws the root's tables and answers the shards."""
    def run(table: pa.Table) -> pa.Table:
        rows = _by_kind(table)
        bucket, _, parts = rows["bucket"][0]
        keys, (contexts, words) = shards.unpacked_keys(parts[0]), [unpacked(x, np.uint64).astype(np.int64) for x in parts[2:]]
        places = [np.searchsorted(keys, shards.unpacked_keys(p[0])) for _, _, p in rows["said"]]
        for at, (_, _, p) in zip(places, rows["said"]):
            contexts[at] += unpacked(p[1], np.uint32)
            words[at] += unpacked(p[2], np.uint32)
        tables = np.minimum(words, 1)
        if sweep:
            own = unpacked(rows["root"][0][2][0], np.uint32).reshape(-1, 3)[:, 2]
            rng = np.random.default_rng([sweep, bucket, 1])
            tables = drawn_tables(words, np.full(len(keys), 1 / (vocabulary_size + 1)), (root_tables - own.astype(np.int64)).astype(float),
                                  ROOT_DISCOUNT, ROOT_STRENGTH, np.array(stirling), rng, limit=True)
        seats = np.column_stack([contexts, words, tables]).astype(np.uint32)
        return pa.concat_tables([
            _row("root", bucket, sweep, shards.packed(seats), a=int(words.sum()), b=int(tables.sum())),
            *[_row("answer", bucket, shard, shards.packed(seats[at])) for at, (_, shard, _) in zip(places, rows["said"])]])

    return run


def schema_table(table: pa.Table, carried: list[str], whole: list, real: list) -> pa.Table:
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return pa.table({**{c: table[c] for c in carried},
                     **{c: pa.array(np.asarray(v, np.int64)) for c, v in zip(names, whole)},
                     **{c: pa.array(np.asarray(v, np.float64)) for c, v in zip(names[3:], real)}})


def _train_tokens(source: DataFrame, text: str) -> int:
    """Tokens of the texts learnt from, ends included."""
    def run(batches):
        for batch in text_slices(batches, text):
            data, offsets = text_bytes(batch.column(text))
            inside = SPACED[data]
            opens = inside.copy()
            opens[1:] &= ~inside[:-1]
            first = offsets[:-1][offsets[:-1] < len(data)]
            opens[first] = inside[first]
            yield pa.RecordBatch.from_arrays([pa.array([int(opens.sum()) + batch.num_rows], pa.int64())], names=["n"])

    return source.filter("_learn").select(f"`{text}`").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
