"""Statistics, line, season and outliers of series held as arrays, in built-in array functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.functions.let import let

Values = Column  # an array of numbers


def _total(values: Values) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _numbers(values: Values) -> Column:
    return F.transform(values, lambda x: x.cast("double"))


def quantile(ordered: Values, share: float) -> Column:
    """The linearly interpolated quantile of an ascending array; null of an empty one."""
    last = F.size(ordered) - 1
    place = last * F.lit(float(share))
    low = F.floor(place).cast("int")
    below, above = F.get(ordered, low), F.get(ordered, F.least(low + 1, last))
    return F.when(last >= 0, below + (above - below) * (place - low))


def series_stats(df: DataFrame, series: str, prefix: str | None = None) -> DataFrame:
    """Adds ``<prefix>_min``, ``_min_idx``, ``_max``, ``_max_idx``, ``_avg``, ``_stdev`` and ``_variance`` (of a sample).

    Places count from 0 and are the first ones; nulls are passed over. An empty series has nulls, one value has no spread.
    """
    name = prefix or series
    there = F.filter(F.transform(series, lambda x, i: F.struct(x.cast("double").alias("x"), i.alias("i"))), lambda e: e["x"].isNotNull())

    def stats(e: Column) -> Column:
        n = F.size(e)
        values = F.transform(e, lambda s: s["x"])
        low = F.array_min(e)
        high = F.array_max(F.transform(e, lambda s: F.struct(s["x"].alias("x"), (-s["i"]).alias("i"))))

        def spread(mean: Column) -> Column:
            squares = _total(F.transform(values, lambda x: (x - mean) * (x - mean)))
            variance = F.when(n > 1, squares / (n - 1))
            return F.struct(low["x"].alias("min"), low["i"].alias("min_idx"), high["x"].alias("max"), (-high["i"]).alias("max_idx"),
                            mean.alias("avg"), F.sqrt(variance).alias("stdev"), variance.alias("variance"))

        return let(F.when(n > 0, _total(values) / n), spread)

    found = df.withColumn("_stats", let(there, stats))
    return found.withColumns({f"{name}_{c}": F.col(f"_stats.{c}") for c in (
        "min", "min_idx", "max", "max_idx", "avg", "stdev", "variance")}).drop("_stats")


def _line(values: Values, then: Callable[[Column, Column], Column]) -> Column:
    """``then(slope, intercept)`` of the least-squares line over the places 0, 1, 2, ..."""
    n = F.size(values).cast("double")
    middle = (n - 1) / 2

    def fitted(mean: Column) -> Column:
        across = _total(F.transform(values, lambda x, i: (x - mean) * (i - middle)))
        along = n * (n * n - 1) / 12
        return let(F.when(along > 0, across / along).otherwise(0.0), lambda slope: then(slope, mean - slope * middle))

    return let(_total(values) / n, fitted)


def series_fit_line(df: DataFrame, series: str, slope: str = "slope", intercept: str = "intercept", fitted: str = "line_fit",
                    r_squared: str = "rsquare") -> DataFrame:
    """Adds the least-squares line of each series: slope per place, value at place 0, its values, and the share of the
    variance it explains (null for a series without variance)."""
    def described(v: Column) -> Column:
        def result(a: Column, b: Column) -> Column:
            line = F.transform(v, lambda _, i: b + a * i)
            mean = _total(v) / F.size(v)
            rest = _total(F.zip_with(v, line, lambda x, y: (x - y) * (x - y)))
            whole = _total(F.transform(v, lambda x: (x - mean) * (x - mean)))
            return F.struct(a.alias("a"), b.alias("b"), line.alias("line"), F.when(whole > 0, 1 - rest / whole).alias("r"))

        return _line(v, result)

    found = df.withColumn("_fit", F.when(F.size(series) > 0, let(_numbers(F.col(series)), described)))
    return found.withColumns({slope: F.col("_fit.a"), intercept: F.col("_fit.b"), fitted: F.col("_fit.line"),
                              r_squared: F.col("_fit.r")}).drop("_fit")


def _fence_scores(values: Values, low: float, high: float) -> Column:
    """How far each value lies outside of two quantiles, in multiples of their distance; 0 between them."""
    def scores(ordered: Column) -> Column:
        return let(F.struct(quantile(ordered, low).alias("low"), quantile(ordered, high).alias("high")), lambda q: F.transform(
            values, lambda x: F.when(x > q["high"], (x - q["high"]) / wide(q)).when(x < q["low"], (x - q["low"]) / wide(q)).otherwise(
                F.when(x.isNotNull(), 0.0))))

    def wide(q: Column) -> Column:
        return F.when(q["high"] > q["low"], q["high"] - q["low"]).otherwise(1e-9)

    return let(F.array_sort(F.filter(values, lambda x: x.isNotNull())), scores)


def series_outliers(df: DataFrame, series: str, score: str = "outliers", low: float = 10, high: float = 90) -> DataFrame:
    """Adds each point's distance outside of the fences, the percentiles ``low`` and ``high`` (25 and 75 are Tukey's), in
    multiples of the fences' distance: 1.5 and more is unusual, 3 and more very much so, below the lower fence it is
    negative. Fences at one place count as 1e-9 apart. Nulls have no score."""
    if not 0 <= low < high <= 100:
        raise ValueError("two different percentiles in ascending order")
    return df.withColumn(score, let(_numbers(F.col(series)), lambda v: _fence_scores(v, low / 100, high / 100)))


def _period(values: Values, least: float, longest: int | None) -> Column:
    """The lag at which a series is most like itself, among lags more like it than their neighbours; 0 if none
    reaches ``least``."""
    n = F.size(values)

    def likeness(lag: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), n - 1 - lag), F.lit(0.0),
                           lambda a, i: a + F.get(values, i) * F.get(values, i + lag))

    def best(whole: Column) -> Column:
        most = F.floor(n / 2).cast("int")
        most = most if longest is None else F.least(most, F.lit(longest))
        lags = F.sequence(F.lit(1), most + 1)

        def among(likes: Column) -> Column:  # likes[k] belongs to the lag k + 1
            inner = F.transform(F.slice(likes, 2, F.greatest(F.size(likes) - 2, F.lit(0))), lambda r, k: F.struct(
                F.when((r > F.get(likes, k)) & (r >= F.get(likes, k + 2)), r).alias("r"), (-(k + 2)).alias("lag")))
            peak = F.array_max(F.filter(inner, lambda e: e["r"] >= F.lit(least)))
            return F.coalesce(-peak["lag"], F.lit(0))

        return F.when((n >= 4) & (whole > 0), let(F.transform(lags, lambda lag: likeness(lag) / whole), among)).otherwise(0)

    return let(_total(F.transform(values, lambda x: x * x)), best)


def series_decompose(df: DataFrame, series: str, period: int | None = None, least: float = 0.3, longest: int | None = None,
                     prefix: str | None = None) -> DataFrame:
    """Adds ``<prefix>_period``, ``_seasonal``, ``_trend``, ``_baseline`` (their sum) and ``_residual`` of each series.

    The trend is the least-squares line. The period, if not given, is the lag at which what the line leaves is most like
    itself: of the lags of 2 up to half the series (``longest``) whose autocorrelation is above that of the lag before
    and not below that of the next, the one with the largest, 0 where none reaches ``least``. The season of a place is
    the median of what the line leaves at its places in all periods, less the mean of these medians. Nulls count as 0.
    Looking for the period takes time with the square of a series' length; ``longest`` bounds it.
    """
    name = prefix or series
    if period is not None and period < 0:
        raise ValueError("a period is not negative")

    def split(v: Column) -> Column:
        def with_line(a: Column, b: Column) -> Column:
            return let(F.transform(v, lambda x, i: x - (b + a * i)), lambda rest: with_rest(a, b, rest))

        def with_rest(a: Column, b: Column, rest: Column) -> Column:
            found = F.lit(period) if period is not None else _period(rest, least, longest)
            return let(found, lambda p: seasonal(a, b, rest, p))

        def seasonal(a: Column, b: Column, rest: Column, p: Column) -> Column:
            medians = F.when(p > 1, F.transform(F.sequence(F.lit(0), F.greatest(p, F.lit(1)) - 1), lambda k: quantile(F.array_sort(
                F.filter(rest, lambda _, i: F.pmod(i, p) == k)), 0.5))).otherwise(F.array(F.lit(0.0)))
            return let(F.filter(medians, lambda x: x.isNotNull()), lambda m: let(_total(m) / F.size(m), lambda mean: F.struct(
                p.alias("period"),
                F.transform(v, lambda _, i: F.coalesce(F.get(m, F.pmod(i, F.size(m))), F.lit(0.0)) - mean).alias("seasonal"),
                F.transform(v, lambda _, i: b + a * i).alias("trend"))))

        return _line(v, with_line)

    values = F.transform(series, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    found = df.withColumn("_parts", F.when(F.size(series) > 0, let(values, split)))
    found = found.withColumns({f"{name}_{c}": F.col(f"_parts.{c}") for c in ("period", "seasonal", "trend")}).drop("_parts")
    found = found.withColumn(f"{name}_baseline", F.zip_with(f"{name}_seasonal", f"{name}_trend", lambda s, t: s + t))
    return found.withColumn(f"{name}_residual", F.zip_with(values, f"{name}_baseline", lambda x, b: x - b))


def series_decompose_anomalies(df: DataFrame, series: str, threshold: float = 1.5, period: int | None = None, flag: str = "AnomalyFlag",
                               score: str = "AnomalyScore", baseline: str = "Baseline", low: float = 10, high: float = 90,
                               **search) -> DataFrame:
    """Adds flags (1, -1 or 0), scores and the baseline of each series: what season and line do not explain, held
    against the fences of ``series_outliers``; flagged beyond ``threshold``."""
    parts = series_decompose(df, series, period, prefix="_d", **search)
    scored = series_outliers(parts, "_d_residual", score, low, high)
    return scored.withColumn(flag, F.transform(score, lambda s: F.when(s > threshold, 1).when(s < -threshold, -1).otherwise(0))).withColumn(
        baseline, F.col("_d_baseline")).drop(*[f"_d_{c}" for c in ("period", "seasonal", "trend", "baseline", "residual")])
