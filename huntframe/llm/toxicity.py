"""Toxicity by class-conditional Kneser-Ney models.

Two word bigram models are counted, one on toxic and one on ordinary texts. Each backs off to the word
frequencies of its own class, and these to backoff counts that both classes share. A class keeps of a
count only what clearly exceeds the other class's count; as in Kneser-Ney smoothing, what is discounted
makes up the shared backoff counts, so an expression too rare to tell the classes apart, or equally
common in both, scores alike in both. A text's score is the difference of its two log-likelihoods per
word, turned into a probability by a logistic curve fitted on labelled texts that the models have not
counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntframe.llm.components import _stored
from huntframe.llm.sampling import LONGEST, SLICE, bounded_sample, near_copy_marks, with_texts, without_near_copies
from huntframe.llm.share import Shared
from huntframe.llm.shards import _release
from huntframe.llm.text import ALPHANUMERIC, Powers, Words, byte_codes, chained, text_bytes, text_slices

SAMPLE_ROWS = 12_000  # labelled rows of each class
SAMPLE_BYTES = 16 << 20  # bytes of their texts, per class
COUNTED = 0.7  # of the sample; the rest fits the logistic curve
LEAST_TEXTS = 8  # of each class, for the curve; with fewer it is fitted on parts of the sample in turn, or else given
PARTS = 4  # of a small sample: each part is judged by models that have counted the others
SMALL_DISCOUNT, SMALL_SPREAD = 1.0, 0.5  # where so few texts are counted: a word has to stand in two at least
GIVEN = {"middle": [0.0] * 3, "scale": [0.05, 1.0, 1.0], "beta": [-1.0, 4.0, 0.0, 0.0]}  # for fewer: by the difference per word
DISCOUNT = 2.0  # texts taken from every count of a class,
SPREADS = (2.0, 3.0, 4.0)  # and so many standard deviations of a chance difference; the best of these is used
START = np.uint64(1)  # stands before the first word of a text
ALONE = 0  # stands in place of the word before where words are counted by themselves


def _before(words: Words) -> np.ndarray:
    """The word before each word."""
    before = np.empty(len(words), np.uint64)
    if len(words):
        before[1:] = words.hash[:-1]
        first = words.border[:-1][words.border[:-1] < words.border[1:]]
        before[first] = START
    return before


def _counted(sample: DataFrame) -> DataFrame:
    """In how many sampled texts of either class a word stands, and stands after another: (before, word, n0, n1)."""
    def run(batches):
        powers, codes = Powers(), byte_codes()
        for batch in text_slices(batches, most=SLICE):
            words = Words(*text_bytes(batch.column("text")), ALPHANUMERIC, powers, codes)
            n = len(words)
            table = pa.table({
                "text": np.concatenate([words.text, words.text]),
                "before": np.concatenate([np.full(n, ALONE), _before(words).view(np.int64)]),
                "word": np.concatenate([words.hash, words.hash]).view(np.int64)}).group_by(
                    ["text", "before", "word"]).aggregate([])
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)[table["text"].to_numpy()]
            table = table.append_column("n0", pa.array(1 - toxic)).append_column("n1", pa.array(toxic))
            counts = table.group_by(["before", "word"]).aggregate([("n0", "sum"), ("n1", "sum")])
            yield from counts.rename_columns(["before", "word", "n0", "n1"]).to_batches()
        _release()

    rows = sample.select("text", F.col("toxic").cast("long")).mapInArrow(
        run, "before long, word long, n0 long, n1 long")
    return rows.groupBy("before", "word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _excess(own, other, ratio, spread, discount=DISCOUNT):
    """What a class keeps of a count: the part that the other class's count does not explain."""
    expected = other * ratio
    return F.greatest(own - expected - discount - F.lit(spread) * F.sqrt(own + expected), F.lit(0.0))


class KneserNey:
    """Both models as sorted arrays. Their size is bounded by that of the sample."""

    def __init__(self, words: dict, contexts: dict, pairs: dict):
        self.words, self.contexts, self.pairs = words, contexts, pairs

    @staticmethod
    def fit(counts: DataFrame, spread: float, discount: float = DISCOUNT) -> KneserNey:
        alone = F.col("before") == ALONE
        total = counts.filter(alone).agg(F.sum("n0"), F.sum("n1"), F.count(F.lit(1))).first()
        size = [float(total[0] or 0) + 1, float(total[1] or 0) + 1]
        keeps = [_excess(F.col("n0"), F.col("n1"), F.lit(size[0] / size[1]), spread, discount).alias("own0"),
                 _excess(F.col("n1"), F.col("n0"), F.lit(size[1] / size[0]), spread, discount).alias("own1")]
        cut = counts.select("before", "word", "n0", "n1", *keeps)
        left = F.col("n0") - F.col("own0") + F.col("n1") - F.col("own1")
        shared = cut.filter(alone).agg(F.sum(left), F.sum("own0"), F.sum("own1")).first()
        everywhere = float(shared[0] or 0) + 1

        words = _numpy(cut.filter(alone & ((F.col("own0") > 0) | (F.col("own1") > 0))).select(
            "word", "own0", "own1", left.alias("left")))
        order = np.argsort(words["word"].view(np.uint64))
        back = [1 - float(shared[1 + k] or 0) / size[k] for k in (0, 1)]
        p = np.array([words[f"own{k}"][order] / size[k] + back[k] * (words["left"][order] + 1) / everywhere for k in (0, 1)])
        # A word that neither class keeps differs by the backoff weights alone, whatever its shared count.
        table = {"key": words["word"].view(np.uint64)[order], "logs": np.log(p[1] / p[0]), "p": p,
                 "other": float(np.log(back[1] / back[0]))}

        kept = cut.filter(~alone & ((F.col("own0") > 0) | (F.col("own1") > 0)))
        pairs = _numpy(kept.select("before", "word", "own0", "own1"))
        held = kept.groupBy("before").agg(F.sum("own0").alias("held0"), F.sum("own1").alias("held1"))
        of_contexts = _numpy(cut.filter(~alone).groupBy("before").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).join(
            held, "before"))
        order = np.argsort(of_contexts["before"].view(np.uint64))
        key = of_contexts["before"].view(np.uint64)[order]
        n = np.array([of_contexts[f"n{k}"][order] + 1.0 for k in (0, 1)])
        weight = np.array([1 - of_contexts[f"held{k}"][order] / n[k] for k in (0, 1)])
        at = np.searchsorted(key, pairs["before"].view(np.uint64))
        own = np.array([pairs[f"own{k}"] / n[k, at] for k in (0, 1)])
        pair = chained(pairs["before"].view(np.uint64), pairs["word"].view(np.uint64))
        order = np.argsort(pair)
        least = back[0] / everywhere
        return KneserNey({**table, "least": least}, {"key": key, "logs": np.log(weight[1] / weight[0]), "weight": weight},
                         {"key": pair[order], "own": own[:, order]})

    def difference(self, words: Words) -> np.ndarray:
        """Per word: toxic minus ordinary log-probability."""
        before = _before(words)
        word_at, word_known = _found(self.words["key"], words.hash)
        logs = np.where(word_known, self.words["logs"][word_at], self.words["other"]) if len(self.words["key"]) \
            else np.full(len(words), self.words["other"])
        at, known = _found(self.contexts["key"], before)
        where = np.flatnonzero(known)
        logs[where] += self.contexts["logs"][at[where]]
        # Where the pair itself is kept, its own mass comes on top of the weighted word probability.
        pair_at, pair_known = _found(self.pairs["key"], chained(before[where], words.hash[where]))
        where, pair_at = where[pair_known], pair_at[pair_known]
        if len(where):
            least = np.array([[1.0], [np.exp(self.words["other"])]]) * self.words["least"]
            p = np.where(word_known[where], self.words["p"][:, word_at[where]], least) if len(self.words["key"]) \
                else np.repeat(least, len(where), axis=1)
            p = self.pairs["own"][:, pair_at] + self.contexts["weight"][:, at[where]] * p
            logs[where] = np.log(p[1] / p[0])
        return logs


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _numpy(df: DataFrame) -> dict[str, np.ndarray]:
    table = df.toArrow()
    return {c: table.column(c).to_numpy() for c in table.column_names}


def _features(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Difference per word, the same weighted by how much text speaks for it, and the length."""
    mean = total / np.maximum(n, 1)
    return np.stack([mean, mean * np.sqrt(n), np.log1p(n)], axis=1)


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> dict:
    """Weighted logistic regression by Newton steps, on features brought to a common scale.

    A feature enters as the hyperbolic tangent of its distance from the middle of ordinary texts, so a few
    extreme texts do not flatten the curve for the rest.
    """
    middle = np.median(x[y == 0], axis=0)
    scale = np.maximum(np.quantile(np.abs(x - middle)[y == 1], 0.75, axis=0), 1e-9)
    z = np.column_stack([np.ones(len(x)), np.tanh((x - middle) / scale)])
    beta, keep = np.zeros(z.shape[1]), np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + keep, z.T @ (weight * (y - p)) - keep @ beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ beta, -30, 30))), 1e-6, 1 - 1e-6)
    loss = -float((weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())
    return {"middle": middle.tolist(), "scale": scale.tolist(), "beta": beta.tolist(), "loss": loss}


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES,
        longest: int = LONGEST, near_copies: bool = False) -> dict:
    """A model from ``documents`` (doc_id, text) and ``labels`` (doc_id, toxic 0/1).

    Fitted on a sample of at most ``sample_rows`` rows and about ``sample_bytes`` bytes of each class, of texts of at most
    ``longest`` bytes; near copies within a class are left out of it unless ``near_copies`` is set.
    Rows of one doc_id vote for its label, a tie counts as toxic; null labels and ids are left out. The
    curve is weighted to the share of each class among all labelled rows. With fewer than LEAST_TEXTS different texts
    of a class to fit it, models of all texts are used, with a curve fitted on parts of the sample in turn, or a
    given one if there are too few for that as well. Without both classes there is no model, and every text gets the
    share of toxic rows, or 0 if there are none.
    """
    voted = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(
        (F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    # Only ids, sizes and marks are shuffled; the texts of the bounded sample are fetched at the end. Each step is stored in
    # the shared folder: the plan of a cached table holds those of all before it, and the driver keeps every plan that has run.
    labelled = _stored(near_copy_marks(documents).join(voted, "doc_id"), "labelled")
    share = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    rate = share.get(1, 0) / max(1, sum(share.values()))
    if len(share) < 2:
        return {"rate": rate, "model": None}
    # A text is only left out for one of its own class: what both classes share says something about neither.
    different = labelled if near_copies else _stored(without_near_copies(labelled, within="toxic"), "different")
    sizes = different.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total")).collect()
    drawn = bounded_sample(different, "toxic", min(sample_rows, *[r.n for r in sizes]),
                           min(sample_bytes, *[max(1, r.total) for r in sizes]), longest=longest)
    sample = _stored(with_texts(drawn, documents), "sample")
    spark = documents.sparkSession
    counts = _stored(_counted(sample.filter(F.col("draw") < COUNTED)), "counts")
    rest = sample.filter(F.col("draw") >= COUNTED).select("toxic", "text")
    best = {"rate": rate, "model": None, "loss": np.inf}
    for spread in SPREADS:
        model = KneserNey.fit(counts, spread)
        found = _numpy(_totals(rest, Shared(spark, model), "text").select("toxic", "_total", "_n"))
        y = found["toxic"].astype(float)
        if min(y.sum(), len(y) - y.sum()) >= LEAST_TEXTS:
            weight = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
            curve = _curve(_features(found["_total"], found["_n"]), y, weight)
            if curve["loss"] < best["loss"]:
                best = {"rate": rate, "model": model, **curve}
    if best["model"] is None:
        best = _fit_small(sample, rate)
    return best


def _fit_small(sample: DataFrame, rate: float) -> dict:
    """A model of all texts of a small sample."""
    spark = sample.sparkSession
    whole, x, y = KneserNey.fit(_stored(_counted(sample), "counts"), SMALL_SPREAD, SMALL_DISCOUNT), [], []
    for part in range(PARTS):
        judged = (F.col("draw") * PARTS).cast("int") == part
        model = KneserNey.fit(_stored(_counted(sample.filter(~judged)), "counts"), SMALL_SPREAD, SMALL_DISCOUNT)
        found = _numpy(_totals(sample.filter(judged).select("toxic", "text"), Shared(spark, model), "text").select("toxic", "_total", "_n"))
        x.append(_features(found["_total"], found["_n"]))
        y.append(found["toxic"].astype(float))
    x, y = np.concatenate(x), np.concatenate(y)
    if min(y.sum(), len(y) - y.sum()) < LEAST_TEXTS:
        return {"rate": rate, "model": whole, **GIVEN}
    return {"rate": rate, "model": whole, **_curve(x, y, np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean())), ridge=1.0)}


def _totals(docs: DataFrame, model, text: str) -> DataFrame:
    """Adds the summed difference (``_total``) and the words (``_n``)."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_total", T.DoubleType()), T.StructField("_n", T.LongType())])

    def run(batches):
        powers, codes, known = Powers(), byte_codes(), model.value
        for batch in text_slices(batches, text, SLICE):
            words = Words(*text_bytes(batch.column(text)), ALPHANUMERIC, powers, codes)
            sums = np.concatenate([[0.0], np.cumsum(known.difference(words))])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.diff(sums[words.border])), pa.array(np.diff(words.border))],
                names=[*batch.schema.names, "_total", "_n"])
        _release()

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, fitted: dict, text: str = "text", to: str = "score") -> DataFrame:
    """Adds the probability that a text is toxic. A text without words, null or empty, gets the curve's value
    at no words. Each row is scored alone; a column of that name is replaced."""
    docs = docs.drop(to)
    if fitted["model"] is None:
        return docs.withColumn(to, F.lit(float(fitted["rate"])))
    model = Shared(docs.sparkSession, fitted["model"])
    mean = F.col("_total") / F.greatest(F.col("_n"), F.lit(1))
    features = [mean, mean * F.sqrt("_n"), F.log1p("_n")]
    curve = F.lit(fitted["beta"][0])
    for x, middle, scale, beta in zip(features, fitted["middle"], fitted["scale"], fitted["beta"][1:]):
        curve += F.tanh((x - middle) / scale) * beta
    return _totals(docs, model, text).withColumn(
        to, F.lit(1.0) / (F.lit(1.0) + F.exp(-curve))).drop("_total", "_n")
