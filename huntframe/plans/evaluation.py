"""Batch jobs over evaluation results: rates, paired tests, intervals and agreement."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntframe.functions.predicates import Field, col_of
from huntframe.operators.aggregates import avg, count, maximum, minimum, percentile, summarize
from huntframe.operators.skew import merge_by_key, running_totals


def _rate(hits: Column, of: Column) -> Column:
    return F.when(of > 0, hits / of)


def validity_rate(df: DataFrame, passed: Column, by: list[str] | None = None) -> DataFrame:
    """Share of rows that pass, over all rows and, with ``by``, per group (null group = overall)."""
    flagged = df.withColumn("_ok", F.coalesce(passed, F.lit(False)))
    grouped = flagged.rollup(*by) if by else flagged.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("_ok").alias("passed"),
        F.coalesce(_rate(F.count_if("_ok"), F.count(F.lit(1))), F.lit(0.0)).alias("rate"))


def recovery_rate(df: DataFrame, succeeded: Column, attempts: Field, by: list[str] | None = None) -> DataFrame:
    """Of the cases that did not succeed at the first attempt, the share that succeeded later."""
    success = F.coalesce(succeeded, F.lit(False))
    failed_first = ~(success & F.coalesce(col_of(attempts) == 1, F.lit(False)))
    return df.groupBy(*(by or [])).agg(
        F.count_if(failed_first).alias("failed_first"),
        F.count_if(failed_first & success).alias("recovered"),
    ).withColumn("rate", F.coalesce(_rate(F.col("recovered"), F.col("failed_first")), F.lit(0.0)))


@F.pandas_udf(T.DoubleType())
def _upper_chi_square(statistic: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution with one degree of freedom."""
    return statistic.map(lambda x: math.erfc(math.sqrt(x / 2)))


def mcnemar(df: DataFrame, a: Column, b: Column, by: list[str] | None = None) -> DataFrame:
    """Paired test of two yes/no outcomes: the four counts, the p-value and the kind of test.

    Exact binomial below 25 discordant pairs, otherwise chi-square with continuity correction.
    """
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    table = df.groupBy(*(by or [])).agg(
        F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("a_only"),
        F.count_if(~a & b).alias("b_only"), F.count_if(~a & ~b).alias("neither"))
    n, k = F.col("a_only") + F.col("b_only"), F.least("a_only", "b_only")
    # Sum of C(n, i) for i <= k, each term from the one before it.
    steps = F.filter(F.sequence(F.lit(0), F.lit(24)), lambda i: (i > 0) & (i <= k))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] * (n - i + 1) / i
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    tail = F.aggregate(steps, start, add, lambda s: s["sum"])
    exact = F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), n))
    gap = F.abs(F.col("a_only") - F.col("b_only")) - 1
    statistic = F.when(n >= 25, gap * gap / n).otherwise(F.lit(0.0)).cast("double")
    small = n < 25
    return table.withColumns({
        "p_value": F.when(small, exact).otherwise(_upper_chi_square(statistic)),
        "test": F.when(small, "exact").otherwise("chi-square")})


def bootstrap_means(df: DataFrame, value: Column, replicates: int = 10_000, seed: int = 42,
                    blocks: int = 32) -> DataFrame:
    """Means of ``replicates`` resamples with replacement, each as large as the data.

    Equal values are counted first, and a resample is drawn as multinomial counts: first over
    blocks of values, then along the values of a block, batch by batch. That is the same
    distribution as drawing row by row, but costs one draw per distinct value, not per row, and no
    task holds more than a batch; more ``blocks`` give more tasks. Draws come from seeded generators
    over sorted input, so a repeated task gives the same numbers.
    """
    number = value.try_cast("double")
    counted = (df.select(number.alias("value")).filter(F.col("value").isNotNull())
               .groupBy("value").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("block", F.pmod(F.xxhash64("value"), F.lit(blocks)).cast("int")))
    sizes = counted.groupBy("block").agg(F.sum("n").alias("n"))
    # One entry per block: a short array, whatever the data size. It leads every block as a row.
    layout = sizes.agg(F.sort_array(F.collect_list(F.struct("block", "n"))).alias("layout"))
    heads = layout.select("layout", F.inline(F.col("layout")).alias("block", "_n")).drop("_n")

    class BlockDraws:
        """Sums of resampled values per replicate, for the blocks one task sees."""

        def __init__(self, replicates: int, seed: int):
            self.replicates, self.seed = replicates, seed
            self.sums, self.total = np.zeros(replicates), 0
            self.wanted: dict[int, np.ndarray] = {}
            self.left: dict[int, int] = {}
            self.shares = None

        def open(self, block: int, layout) -> None:
            """Learn how many draws of each replicate fall into a block."""
            ids, sizes = [int(e["block"]) for e in layout], np.array([int(e["n"]) for e in layout])
            if self.shares is None:
                self.total = int(sizes.sum())
                rng = np.random.default_rng(self.seed)
                self.shares = rng.multinomial(self.total, sizes / self.total, size=self.replicates)
            place = ids.index(block)
            self.wanted[block], self.left[block] = self.shares[:, place].copy(), int(sizes[place])

        def add(self, block: int, values: np.ndarray, counts: np.ndarray) -> None:
            """Draw from the next values of a block, out of the draws still due there."""
            start = int(values.view("int64")[0]) & 0x7FFFFFFFFFFFFFFF
            rng = np.random.default_rng([self.seed, block, start])
            size = int(counts.sum())
            here = rng.binomial(self.wanted[block], min(1.0, size / self.left[block]))
            self.wanted[block], self.left[block] = self.wanted[block] - here, self.left[block] - size
            for low in range(0, self.replicates, 256):
                drawn = rng.multinomial(here[low:low + 256], counts / size)
                self.sums[low:low + 256] += drawn @ values

    def draw(batches):
        draws = BlockDraws(replicates, seed)
        for batch in batches:
            for block, part in batch.groupby("block", sort=True):
                head = part[part["layout"].notna()]
                if len(head):
                    draws.open(int(block), head["layout"].iloc[0])
                rows = part[part["layout"].isna()]
                if len(rows):
                    draws.add(int(block), rows["value"].to_numpy(), rows["n"].to_numpy(dtype="int64"))
        if draws.total:
            yield pd.DataFrame({"replicate": np.arange(replicates), "part": draws.sums / draws.total})

    # A fixed number of tasks: the rows are few, but each costs ``replicates`` draws.
    stacked = counted.unionByName(heads, allowMissingColumns=True).repartition(blocks, "block")
    ordered = stacked.sortWithinPartitions("block", F.col("layout").isNull(), "value")
    return (ordered.mapInPandas(draw, "replicate long, part double")
            .groupBy("replicate").agg(F.sum("part").alias("mean")))


def bootstrap_ci(df: DataFrame, value: Column, replicates: int = 10_000, ci: float = 0.95,
                 seed: int = 42) -> DataFrame:
    """Mean of a value with its percentile bootstrap interval."""
    tail = (1 - ci) / 2
    # As many rows as replicates: small enough for Spark's own exact percentile.
    bounds = bootstrap_means(df, value, replicates, seed).agg(
        F.percentile("mean", tail).alias("low"), F.percentile("mean", 1 - tail).alias("high"))
    number = value.try_cast("double")
    point = df.agg(F.count(number).alias("n"), F.avg(number).alias("mean"))
    return merge_by_key([point, bounds], [])


_PRIME = (1 << 31) - 1  # draws are numbers below it


def _poisson_steps(most: int = 14) -> list[int]:
    """From which draw on a Poisson number of mean 1 is at least 1, 2, ..."""
    share, total, steps = math.exp(-1), 0.0, []
    for k in range(most):
        total += share
        share /= k + 1
        steps.append(math.floor(total * _PRIME))
    return [s for s in steps if s < _PRIME]


def poisson_weight(key: str, replicate: str, seed: int = 42) -> str:
    """How often a resample holds a row: a Poisson number of mean 1, from a hash of a whole-number key and the replicate.

    An expression that Spark and other SQL engines read alike; products stay below 2^63.
    """
    p = _PRIME
    mixed = f"((({key} % {p} + {p}) % {p}) * 48271 + {replicate} * 1103515245 + {seed}) % {p}"
    # squares of sums spread the bits; each step is used once
    for factor in (16807, 69621):
        mixed = f"(({mixed}) * {factor} + ((({mixed}) % 46341) * (({mixed}) % 46337)) + {replicate}) % {p}"
    return mixed


def weight_of_draw(draw: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {draw} >= {s} THEN 1 ELSE 0 END" for s in _poisson_steps()) + ")"


def bootstrap_by(df: DataFrame, by: list[str], value: str, key: str, replicates: int = 1000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """Mean of a value per group with its percentile bootstrap interval, all groups in one pass over the rows.

    In each resample a row counts as often as a Poisson number of mean 1 says that a hash of its ``key`` (a whole number
    that names the row) and the resample give: the same on every run and in every task. Sums per group and resample are
    made on the map side, so a group may hold most of the rows. Rows without a value or key take no part; resamples
    without a row of a group do not count for it.
    """
    rows = df.select(*by, F.col(value).try_cast("double").alias("_v"), F.col(key).cast("long").alias("_k"))
    rows = rows.filter("_v is not null and not isnan(_v) and _k is not null")
    drawn = rows.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)).cast("array<long>")))
    drawn = drawn.withColumn("_u", F.expr(poisson_weight("_k", "_r", seed))).withColumn("_w", F.expr(weight_of_draw("_u")))
    sums = drawn.groupBy(*by, "_r").agg(F.sum("_w").alias("_n"), F.sum(F.col("_w") * F.col("_v")).alias("_s"))
    tail = (1 - ci) / 2
    mean = F.when(F.col("_n") > 0, F.col("_s") / F.col("_n"))
    # as many means as resamples per group: small enough for Spark's own exact percentile
    bounds = sums.groupBy(*by).agg(F.percentile(mean, tail).alias("low"), F.percentile(mean, 1 - tail).alias("high"))
    point = rows.groupBy(*by).agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"))
    return merge_by_key([point, bounds], list(by)).select(*by, "n", "mean", "low", "high")


def scorecard(df: DataFrame, by: str, completed: Field, fire_ok: Field, nofire_ok: Field) -> DataFrame:
    """Completion, fire and no-fire shares per template; a share of no case is null."""
    fire, nofire = col_of(fire_ok), col_of(nofire_ok)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(col_of(completed)) / F.count(F.lit(1))).alias("completion"),
        _rate(F.count_if(fire), F.count(fire)).alias("fire"),
        _rate(F.count_if(nofire), F.count(nofire)).alias("nofire"))


def cost_and_latency(df: DataFrame, by: str, tokens: str, seconds: str) -> DataFrame:
    """Average tokens, and average, median and 90th percentile seconds, per template."""
    return summarize(df, [by], n=count(), avg_tokens=avg(tokens), avg_seconds=avg(seconds),
                     median_seconds=percentile(seconds, 50), p90_seconds=percentile(seconds, 90))


def rater_agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Raw agreement and Cohen's kappa (unweighted, linear, quadratic) of two raters.

    Scores are numbers. Everything is worked out from the counts per pair of scores and per score, so beyond one
    grouped count the work depends only on the number of different scores, and these are ranked in ranges.
    """
    cells = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(
        F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(
        F.struct(F.col("a").alias("score"), F.col("n").alias("r"), F.lit(0).cast("long").alias("c")),
        F.struct(F.col("b").alias("score"), F.lit(0).cast("long").alias("r"), F.col("n").alias("c")))
    by_score = cells.select(F.inline(sides)).groupBy("score").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    ranked = running_totals(by_score.withColumn("one", F.lit(1).cast("long")), "score", {"place": "one", "fr": "r", "fc": "c"})
    total = by_score.agg(F.sum("r").cast("double").alias("m"))
    levels = ranked.select("score", "r", "c", (F.col("place") - 1).alias("i"), "fr", "fc").withColumn("m", total.scalar())

    i, r, c, m = F.col("i"), F.col("r"), F.col("c"), F.col("m")
    expected = levels.agg(
        (1 - F.sum(r * c / m / m)).alias("plain"),
        F.sum((F.col("fr") / m) * (1 - F.col("fc") / m) + (F.col("fc") / m) * (1 - F.col("fr") / m)).alias("linear"),
        (F.sum(i * i * (r + c) / m) - 2 * F.sum(i * r / m) * F.sum(i * c / m)).alias("square"))

    index = levels.select("score", "i")
    placed = (cells.join(index.withColumnsRenamed({"score": "a", "i": "ia"}), "a")
              .join(index.withColumnsRenamed({"score": "b", "i": "ib"}), "b"))
    n, gap = F.sum("n"), F.abs(F.col("ia") - F.col("ib"))
    observed = placed.agg(
        n.alias("n"),
        (F.sum(F.when(gap == 0, F.col("n")).otherwise(0)) / n).alias("agreement"),
        (F.sum(gap * F.col("n")) / n).alias("o_linear"),
        (F.sum(gap * gap * F.col("n")) / n).alias("o_square"))
    both = merge_by_key([observed, expected], [])
    return both.filter(F.col("n").isNotNull()).select(
        "n", "agreement",
        (1 - F.try_divide(1 - F.col("agreement"), F.col("plain"))).alias("kappa"),
        (1 - F.try_divide(F.col("o_linear"), F.col("linear"))).alias("kappa_linear"),
        (1 - F.try_divide(F.col("o_square"), F.col("square"))).alias("kappa_quadratic"))


def replication_summary(runs: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Median, quartile range and range of a metric over repeated runs."""
    result = summarize(runs, by or [], runs=count(), median=percentile(value, 50),
                       q1=percentile(value, 25), q3=percentile(value, 75),
                       low=minimum(value), high=maximum(value))
    return result.withColumn("iqr", F.col("q3") - F.col("q1"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row per actual value with the count of each verdict of the checker."""
    hit = F.col(predicted)
    return df.groupBy(actual).agg(
        F.count_if(hit).alias("predicted_true"), F.count_if(~hit).alias("predicted_false"))


def wins_by_condition(scores: DataFrame, case: str, rater: str, condition: str, score: str) -> DataFrame:
    """Per rater and condition: total score, and cases in which no other condition scored higher."""
    best = scores.groupBy(case, rater).agg(F.max(score).alias("_best"))
    judged = scores.join(best, [case, rater]).withColumn("_won", F.col(score) == F.col("_best"))
    return judged.groupBy(rater, condition).agg(
        F.sum(score).alias("total"), F.count_if("_won").alias("best_or_tied"))
