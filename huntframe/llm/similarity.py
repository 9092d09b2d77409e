"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its word shingles. All sets are sorted in one order, frequent shingles last. If two
sets of at least a given similarity are cut to prefixes in which ``l`` more shingles stand than may differ,
the prefixes share at least ``l`` shingles. Each document picks its own ``l``: a longer prefix costs more
look-ups, but asks for more matches before a pair is verified. Frequencies come from a table of fixed size
that counts all shingles of all documents.

A set also has marks, a bit for each of some hundred slots that tells whether an odd number of its shingles fall there.
A shingle that only one of two sets has changes one bit, so sets whose marks differ in more bits than similar sets may
differ in shingles need no look; where sets are not too large, that leaves next to none but the similar ones.

Links, not pairs, are wanted in the end. Equal sets are one vertex; documents that share a prefix shingle are
first compared with one of them, then with some, and only what this leaves unconnected is compared pair by pair, a
pair where it first meets. So a large group of copies does not give rise to all its pairs, and no link between
components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huntframe.llm import shards
from huntframe.llm.components import _stored, connected
from huntframe.llm.share import Shared
from huntframe.llm.text import SPACED, Powers, Words, byte_codes, chained, mixed, text_bytes, text_slices

SKETCH_BITS = 17  # the table of shingle frequencies has 2**17 counts
MOST_MATCHES = 4
VERIFY = 1 / 16  # cost of comparing a shingle of two sets, in look-ups
MARK_BITS = 9  # a set has 2**9 marks, 64 bytes
LOOK_LEADERS = (1, 16)  # leaders of each token and size in the first looks
FIRST_LOOKS = len(LOOK_LEADERS)
MARKED_BITS = 24  # ids of sets to be verified, or shingles to be compared, are marked in 2**24 bits, 2 MB for every task


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int, powers: Powers, codes: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words, the whole sequence is the only one."""
    words = Words(data, offsets, SPACED, powers, codes)
    chain = words.hash
    for step in range(1, size):
        chain = chained(chain[:-1], words.hash[step:]) if len(chain) else chain
    out = []
    for a, b in zip(words.border[:-1].tolist(), words.border[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(chain[a:b - size + 1]))
        elif b > a:
            whole = words.hash[a:a + 1]
            for i in range(a + 1, b):
                whole = chained(whole, words.hash[i:i + 1])
            out.append(mixed(whole + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_frequencies(docs: DataFrame, text: str, size: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """How often shingles fall into each of 2**bits slots, over all documents."""
    def run(batches):
        powers, codes = Powers(), byte_codes()
        total = np.zeros(1 << bits, np.int64)
        for batch in text_slices(batches, text):
            sets = shingle_sets(*text_bytes(batch.column(text)), size, powers, codes)
            total += np.bincount((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(total[slots])], names=["slot", "n"])

    rows = docs.select(text).mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << bits, np.int64)
    table[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return table


class Prefixes:
    """The common order of shingles and each set's prefix in it."""

    def __init__(self, frequencies: np.ndarray, percent: int):
        self.percent, self.shift = percent, np.uint64(64 - int(np.log2(len(frequencies))))
        # Slots hold unrelated shingles too; what the average slot holds says nothing.
        self.cost = np.maximum(frequencies - frequencies.mean(), 1.0)
        self.level = np.log2(self.cost).astype(np.int64)

    def told_by_marks(self, n: int) -> bool:
        """Whether the marks of unrelated sets of this size differ in far more bits than similar sets may differ in shingles."""
        marks = 1 << MARK_BITS
        return 2 * n * (100 - self.percent) / (100 + self.percent) < 0.8 * marks / 2 * (1 - np.exp(-4 * n / marks))

    def of(self, shingles: np.ndarray) -> tuple[np.ndarray, int]:
        """(prefix, matches it asks for)."""
        n = len(shingles)
        if not n:
            return shingles, 1
        slot = (shingles >> self.shift).astype(np.int64)
        order = np.lexsort((shingles, self.level[slot]))
        spare = n - -(-self.percent * n // 100)  # shingles that a similar set may lack
        most = min(MOST_MATCHES, n - spare)
        lookups = np.cumsum(self.cost[slot[order[:spare + most]]])[spare:]
        matches = np.arange(1, most + 1)
        # Look-ups, and candidates: documents found once in the lists can be candidates only if found often enough.
        verify = 0 if self.told_by_marks(n) else VERIFY * n
        chosen = int(np.argmin(lookups * (1 + verify / matches ** 2))) + 1
        return shingles[order[:spare + chosen]], chosen


def _signature(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell different sets apart."""
    return (int(mixed(shingles).sum(dtype=np.uint64)), int(mixed(shingles ^ np.uint64(0x5BD1E9955BD1E995)).sum(dtype=np.uint64)))


def marks_of(shingles: np.ndarray) -> np.ndarray:
    """The marks of a set, as signed 64-bit integers."""
    slots = (mixed(shingles) >> np.uint64(64 - MARK_BITS)).astype(np.int64)
    odd = np.bincount(slots, minlength=1 << MARK_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def reach(n: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """The size up to which another set can be similar if the first shared shingle stands at ``place``: what comes
    before it is not shared, so at most ``n - place`` shingles are."""
    return (n - place) * (100 + percent) // percent - n


def _alike(tokens: np.ndarray, n: np.ndarray, upto: np.ndarray, signature: np.ndarray,
           several: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries by token and size: (order, first place of each token, whether an entry's chain has different sets).

    A chain is a run of entries of a token in which each size is within the reach of an entry before; sets of
    different chains cannot be similar with this as their first shared shingle."""
    order = np.lexsort((n, tokens))
    if not len(order):
        return order, order, np.zeros(0, bool)
    token, size = tokens[order], n[order]
    new = np.concatenate([[True], token[1:] != token[:-1]])
    offset = (np.cumsum(new) - 1) << 32
    furthest = np.maximum.accumulate(np.maximum(upto[order], 0) + offset) - offset
    chain = new.copy()
    chain[1:] |= size[1:] > furthest[:-1]
    begins = np.flatnonzero(chain)
    found = signature[order]
    many = np.minimum.reduceat(found, begins) != np.maximum.reduceat(found, begins)
    if several is not None:
        many |= np.maximum.reduceat(several[order], begins)
    return order, np.flatnonzero(new), np.repeat(many, np.diff(np.append(begins, len(order))))


_ROW = "id long, n long, sig_a long, sig_b long, matches int, tokens array<long>, places array<long>, prefix array<long>, " \
       "shingles array<long>, marks array<long>"


def candidates(docs: DataFrame, size: int, percent: int, shard_bytes: int) -> DataFrame:
    """One row per document (id, text): size and signature of its set and, if its prefix shares a shingle
    with a different set, these shingles, the whole set and its marks."""
    prefixes = Shared(docs.sparkSession, Prefixes(shingle_frequencies(docs, "text", size), percent))
    count = shards.shard_count(docs, "text", shard_bytes)
    texts = shards.sharded(docs, count, "text", shard_bytes)

    def documents(table: pa.Table, powers: Powers):
        codes, known = byte_codes(), prefixes.value
        for batch in text_slices(shards.opened(table).combine_chunks().to_batches()):
            sets = shingle_sets(*text_bytes(batch.column("text")), size, powers, codes)
            for name, shingles in zip(batch.column("id").to_pylist(), sets):
                prefix, matches = known.of(shingles)
                # Prefixes prefer small hashes; mixed, they are spread evenly over the buckets.
                yield name, shingles, mixed(prefix), matches

    def wanted(found) -> dict[str, np.ndarray]:
        """The distinct prefix shingles with the least size and the largest reach of their sets, the signature of
        one, and whether sets that may be similar differ."""
        lengths = [len(p) for _, _, p, _ in found]
        tokens = np.concatenate([np.zeros(0, np.uint64), *[p for _, _, p, _ in found]])
        n = np.repeat(np.array([len(s) for _, s, _, _ in found], np.int64), lengths)
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(k) for k in lengths]])
        signature = np.repeat(np.array([_signature(s)[0] for _, s, _, _ in found], np.uint64), lengths)
        order, first, several = _alike(tokens, n, reach(n, place, percent), signature)
        return {"keys": tokens[order][first], "n": np.minimum.reduceat(n[order], first) if len(first) else n,
                "reach": np.maximum.reduceat(reach(n, place, percent)[order], first) if len(first) else n,
                "signature": signature[order][first],
                "several": np.maximum.reduceat(several, first).astype(np.uint8) if len(first) else np.zeros(0, np.uint8)}

    def ask(table: pa.Table) -> pa.Table:
        return shards.runs(table["shard"][0].as_py(), count, **wanted(list(documents(table, Powers()))))

    def shared(keys, _, arrays):
        order, _, many = _alike(keys, arrays["n"], arrays["reach"], arrays["signature"], arrays["several"] > 0)
        out = np.empty(len(keys), np.uint8)
        out[order] = many
        return out

    asked = texts.groupBy("shard").applyInArrow(
        shards.releasing(ask), "bucket int, shard long, keys binary, n binary, reach binary, signature binary, several binary")
    replies = shards.answered(asked, {"n": np.int64, "reach": np.int64, "signature": np.uint64, "several": np.uint8}, shared)

    def tell(table: pa.Table, answers: pa.Table) -> pa.Table:
        found = list(documents(table, Powers()))
        keys = wanted(found)["keys"]
        keys = keys[shards.answers_of(answers, np.uint8) > 0]
        rows = []
        for name, shingles, prefix, matches in found:
            a, b = _signature(shingles)
            near = np.minimum(np.searchsorted(keys, prefix), len(keys) - 1)
            places = np.flatnonzero(keys[near] == prefix) if len(keys) else np.zeros(0, np.int64)
            some = len(places) > 0
            rows.append((name, len(shingles), a, b, matches, 
                         *((prefix[places], places, prefix, shingles, marks_of(shingles)) if some else [None] * 5)))

        def signed(x):
            return None if x is None else np.array(x, np.uint64).view(np.int64)
        columns = list(zip(*rows)) if rows else [[]] * 10
        return pa.table({
            "id": pa.array(columns[0], pa.int64()), "n": pa.array(columns[1], pa.int64()),
            "sig_a": pa.array(signed(list(columns[2])), pa.int64()), "sig_b": pa.array(signed(list(columns[3])), pa.int64()),
            "matches": pa.array(columns[4], pa.int32()),
            "tokens": pa.array([signed(x) for x in columns[5]], pa.list_(pa.int64())),
            "places": pa.array(list(columns[6]), pa.list_(pa.int64())),
            "prefix": pa.array([signed(x) for x in columns[7]], pa.list_(pa.int64())),
            "shingles": pa.array([signed(x) for x in columns[8]], pa.list_(pa.int64())),
            "marks": pa.array(list(columns[9]), pa.list_(pa.int64()))})

    return texts.groupBy("shard").cogroup(shards.by_shard(replies, count)).applyInArrow(shards.releasing(tell), _ROW)


def _holding(rows: DataFrame, name: str, wanted: DataFrame) -> DataFrame:
    """The rows of which ``wanted``, a table of one column, holds the key, and those few whose keys fall on the same
    marks: the others need not be moved."""
    def place(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(1 << MARKED_BITS))

    slot, of_wanted = place(F.col(name)), place(F.col(wanted.columns[0]))
    bit = F.bitmap_bit_position(slot)
    marks = wanted.groupBy(F.bitmap_bucket_number(of_wanted).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(of_wanted)).alias("_marks"))
    byte = F.conv(F.hex(F.substring("_marks", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) > 0
    return rows.withColumn("_bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(marks), "_bucket").filter(marked).select(*rows.columns)


def _asked(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets of which pairs hold the id."""
    return _holding(sets, "id", pairs.select(F.explode(F.array("a", "b")).alias("id")))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. ``pairs`` is a stored table: it is read for each side."""
    asked = _asked(sets, pairs)

    def of(name: str) -> DataFrame:
        return asked.select(F.col("id").alias(name), F.col("shingles").alias(f"shingles_{name}"))

    both = pairs.join(of("a"), "a").join(of("b"), "b")
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    union = F.size("shingles_a") + F.size("shingles_b") - common
    return both.filter(common * 100 >= union * percent).select("a", "b")


def _near(percent: int) -> Column:
    """Two sets by one shared prefix shingle, if it is the first: nothing before it is shared, at most all that
    follows in both is."""
    left = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    return left * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent


def _alike_by_marks(percent: int) -> Column:
    """Two sets whose marks differ in no more bits than similar sets of their sizes differ in shingles."""
    differ = sum(F.bit_count(F.get("marks_a", F.lit(i)).bitwiseXOR(F.get("marks_b", F.lit(i)))) for i in range(1 << MARK_BITS - 6))
    return differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)


def _side(tokens: DataFrame, name: str, *more: str) -> DataFrame:
    """Sets by a shingle of their prefixes, as one side of pairs."""
    own = [c for c in ("id", "n", "place", "marks", "earlier") if c in tokens.columns]
    return tokens.select("token", *more, *[F.col(c).alias(f"{c}_{name}") for c in own])


def _unlike_components(tokens: DataFrame, several: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets of different components that may be similar, by the shingles of ``several``. Sets of a group share most of their
    prefixes; a pair is told at the first shingle of both lists only, so that it is made once."""
    earlier = F.slice("tokens", F.lit(1), (F.array_position("tokens", F.col("token")) - 1).cast("int"))
    left = _holding(tokens, "token", several).withColumn("earlier", earlier).repartition("token").join(several, "token", "left_semi")
    condition = (F.col("component") != F.col("other")) & (F.col("id_a") < F.col("id_b")) & (
        F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return _side(left, "a", "component").join(_side(left.withColumnRenamed("component", "other"), "b", "other"), "token").filter(
        condition & _near(percent) & _alike_by_marks(percent) & ~F.arrays_overlap("earlier_a", "earlier_b")).select(
        F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def _may_link(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share as many prefix shingles as both ask for, and may share enough in all: those,
    and at most what follows the last of them in both sets on the shorter prefix (in the common order, in
    which a prefix is the beginning of a set). A pair of which one asks for one shingle is known to share it; it is not
    looked up again."""
    several = sets.filter("matches > 1")

    def of(name: str) -> DataFrame:
        return several.select(F.col("id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("n", "matches", "prefix")])

    shared = F.array_intersect("prefix_a", "prefix_b")
    found = F.size(shared)
    last = F.get(shared, found - 1)
    rest = [F.col(f"n_{s}") - F.array_position(f"prefix_{s}", last) for s in "ab"]
    # Behind the end of a prefix all may be shared, between the last shared one and that end nothing of it is.
    inside = [F.size(f"prefix_{s}") - F.array_position(f"prefix_{s}", last) for s in "ab"]
    most = found + F.least(rest[0], rest[1], F.greatest(rest[0] - inside[0], rest[1] - inside[1]))
    one = F.col("matches_a").isNull() | F.col("matches_b").isNull()
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(
        one | (found >= F.least("matches_a", "matches_b")) & (most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)).select(
        "a", "b").distinct()


def link(docs: DataFrame, size: int = 5, percent: int = 80, name: str = "doc_id", text: str = "text",
         shard_bytes: int = shards.SHARD_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per row of ``docs``.

    Words are what stands between ASCII white space, in small ASCII letters; a set holds the distinct shingles of
    ``size`` words, or the whole sequence if there are fewer words. Two documents link if 100 times the
    shingles they share are at least ``percent`` times those they have together; ``component_id`` is the
    smallest id that links reach. Without words (null, empty or blank text) a set is empty and links with
    nothing. Rows of one id are one vertex and link what any of them links; rows without an id take no part
    and have no component. Other columns are left out.
    """
    source = docs.select(F.col(f"`{name}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = _stored(candidates(source, size, percent, shard_bytes), "sets")

    linkable = rows.filter("n > 0 and id is not null")
    vertices = linkable.groupBy("sig_a", "sig_b").agg(F.min("id").alias("vertex"))
    member = linkable.select("id", "sig_a", "sig_b").join(vertices, ["sig_a", "sig_b"]).select("id", "vertex")
    # Rows of one id with different texts connect their vertices.
    one = member.groupBy("id").agg(F.min("vertex").alias("a"), F.max("vertex").alias("b")).filter("a != b").select("id", "a")
    repeated = member.join(one, "id").select("a", F.col("vertex").alias("b")).filter("a != b")

    # Whole sets are looked up by id where pairs are verified; all else moves without them.
    sets = rows.filter(F.col("tokens").isNotNull() & F.col("id").isNotNull()).select("id", "n", "matches", "prefix", "shingles")
    listed = rows.filter(F.col("tokens").isNotNull()).select("id", "n", "sig_a", "sig_b", "tokens", "places", "marks").join(
        vertices, ["sig_a", "sig_b"]).filter("id = vertex").select("id", "n", "tokens", "places", "marks")

    def placed(known: DataFrame | None) -> DataFrame:
        """Components are looked up before the lists are taken apart."""
        return listed.withColumn("component", F.col("id")) if known is None else listed.join(known, "id", "left").withColumn(
            "component", F.coalesce("component", "id"))

    def tokens(known: DataFrame | None) -> DataFrame:
        """A row per vertex and prefix shingle."""
        return placed(known).select("id", "n", "component", "marks", "tokens", F.inline(
            F.arrays_zip(F.col("tokens").alias("token"), F.col("places").alias("place"))))

    def several(known: DataFrame) -> DataFrame:
        """The shingles that stand in several components. Only the rows of these are dealt out with all they hold."""
        found = placed(known).select("component", F.explode("tokens").alias("token")).groupBy("token").agg(
            F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high")
        return _stored(found.select("token"), "tokens")

    # First looks: each document against leaders of those that share a shingle and are of like size. Leaders are
    # picked by a hash of their id, so the shingles of one group of copies mostly agree on theirs. One leader joins
    # the bulk of a group; documents that it missed, which would all be compared with that bulk, then meet several.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    links = repeated
    known = None
    for look, many in enumerate(LOOK_LEADERS):
        # Dealt out once, for the leaders and for their followers.
        near = tokens(known) if known is None else _holding(tokens(known), "token", several(known))
        near = near.drop("tokens").withColumn("band", band).repartition("token", "band")
        of_each = Window.partitionBy("token", "band")
        leaders = near.withColumn("first", F.row_number().over(of_each.orderBy(F.xxhash64("id", F.lit(look)), "id"))).filter(
            F.col("first") <= many).withColumnRenamed("component", "other")
        star = _side(near, "a", "band", "component").join(_side(leaders, "b", "band", "other"), ["token", "band"]).filter(
            (F.col("component") != F.col("other")) & _near(percent) & _alike_by_marks(percent))
        star = star.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()
        star = _stored(_may_link(star, sets, percent), "pairs")
        links = links.union(_stored(_verified(star, sets, percent), "links"))
        known = connected(links)

    # Last look: pairs of documents that are not connected yet.
    pairs = _unlike_components(tokens(known), several(known), percent).distinct()
    pairs = _stored(_may_link(pairs, sets, percent), "pairs")
    second = _stored(_verified(pairs, sets, percent), "links")
    components = connected(known.select(F.col("id").alias("a"), F.col("component").alias("b")).union(second))

    of_documents = member.join(components, F.col("vertex") == components["id"], "left").groupBy(member["id"]).agg(
        F.min(F.coalesce("component", "vertex")).alias("component"))
    return rows.select("id", "n").join(of_documents, "id", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"))
