"""T4: statistics, line, season and outlier fences of series."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from huntframe.operators.aggregates import total
from huntframe.operators.seasons import series_decompose, series_decompose_anomalies, series_fit_line, series_outliers, series_stats
from huntframe.operators.series import expand_series, make_series
from huntframe.queries.registry import Tables, query, rounded

_FROM, _TO = datetime(2024, 1, 2), datetime(2024, 1, 16)
# Events count ten times in working hours, so that the series has a season.
_WEIGHT = "CASE WHEN extract(hour FROM ts) BETWEEN 9 AND 16 THEN 10.0 ELSE 1.0 END"
_HOURLY = f"""SELECT event_type, i, CAST(sum(coalesce(w, 0)) AS DOUBLE) AS x FROM (SELECT DISTINCT event_type FROM events),
    (SELECT unnest(range(336)) AS i) LEFT JOIN (SELECT event_type AS kind, date_diff('hour', TIMESTAMP '{_FROM}', ts) AS h, {_WEIGHT} AS w
        FROM events WHERE ts >= TIMESTAMP '{_FROM}' AND ts < TIMESTAMP '{_TO}') ON kind = event_type AND h = i GROUP BY event_type, i"""


def _hourly(t: Tables):
    weighted = t.events.withColumn("w", F.expr(_WEIGHT.replace("10.0", "10.0D").replace("1.0 END", "1.0D END")))
    return make_series(weighted, _FROM, _TO, "PT1H", ["event_type"], "ts", x=total("w"))


@query("T4_series_stats", f"""SELECT event_type, min(x) AS x_min, arg_min(i, (x, i)) AS x_min_idx, max(x) AS x_max, arg_max(i, (x, -i)) AS x_max_idx,
    round(avg(x), 6) AS x_avg, round(stddev_samp(x), 6) AS x_stdev, round(var_samp(x), 6) AS x_variance FROM ({_HOURLY}) GROUP BY event_type""")
def _(t: Tables):
    out = series_stats(_hourly(t), "x").drop("ts", "x")
    out = out.withColumns({c: F.col(c).cast("long") for c in ("x_min_idx", "x_max_idx")})
    return rounded(out, 6, "x_avg", "x_stdev", "x_variance")


@query("T4_series_fit_line", f"""SELECT event_type, round(regr_slope(x, i), 6) AS slope, round(regr_intercept(x, i), 6) AS intercept,
    round(regr_r2(x, i), 6) AS rsquare FROM ({_HOURLY}) GROUP BY event_type""")
def _(t: Tables):
    out = series_fit_line(_hourly(t), "x").select("event_type", "slope", "intercept", "rsquare")
    return rounded(out, 6, "slope", "intercept", "rsquare")


def _fences(rows: str, key: str, value: str, low: float, high: float) -> str:
    return f"""SELECT *, CASE WHEN {value} > hi THEN ({value} - hi) / CASE WHEN hi > lo THEN hi - lo ELSE 1e-9 END
        WHEN {value} < lo THEN ({value} - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1e-9 END ELSE 0 END AS score FROM (SELECT *,
        quantile_cont({value}, {low}) OVER (PARTITION BY {key}) AS lo, quantile_cont({value}, {high}) OVER (PARTITION BY {key}) AS hi FROM ({rows}))"""


@query("T4_series_outliers", f"""SELECT event_type, i, x, round(score, 6) AS score FROM ({_fences(_HOURLY, 'event_type', 'x', 0.25, 0.75)})""")
def _(t: Tables):
    out = series_outliers(_hourly(t), "x", "score", 25, 75)
    rows = out.select("event_type", F.posexplode(F.arrays_zip("x", "score")).alias("i", "p")).select(
        "event_type", F.col("i").cast("long").alias("i"), "p.x", "p.score")
    return rounded(rows, 6, "score")


# What the line leaves; the best lag among the local peaks of its autocorrelation; medians by place in the period.
_PARTS = f"""WITH h AS ({_HOURLY}),
    d AS (SELECT *, x - trend AS rest FROM (SELECT h.*, a.b + a.a * i AS trend FROM h JOIN (SELECT event_type, regr_slope(x, i) AS a,
        regr_intercept(x, i) AS b FROM h GROUP BY event_type) a USING (event_type))),
    r AS (SELECT p.event_type, q.i - p.i AS lag, sum(p.rest * q.rest) / any_value(w) AS r FROM d p JOIN d q ON q.event_type = p.event_type
        AND q.i - p.i BETWEEN 1 AND 169 JOIN (SELECT event_type, sum(rest * rest) AS w FROM d GROUP BY event_type) t ON t.event_type = p.event_type GROUP BY 1, 2),
    peaks AS (SELECT *, r > lag(r) OVER o AND r >= lead(r) OVER o AS peak FROM r WINDOW o AS (PARTITION BY event_type ORDER BY lag)),
    per AS (SELECT k.event_type, coalesce(arg_max(lag, (r, -lag)) FILTER (peak AND r >= 0.3 AND lag BETWEEN 2 AND 168), 0) AS period
        FROM (SELECT DISTINCT event_type FROM h) k LEFT JOIN peaks USING (event_type) GROUP BY k.event_type),
    m AS (SELECT event_type, period, CASE WHEN period > 1 THEN i % period ELSE 0 END AS k, CASE WHEN period > 1 THEN quantile_cont(rest, 0.5) ELSE 0 END AS med
        FROM d JOIN per USING (event_type) GROUP BY event_type, period, k),
    s AS (SELECT event_type, period, k, med - avg(med) OVER (PARTITION BY event_type) AS seasonal FROM m),
    parts AS (SELECT event_type, i, x, period, seasonal, trend, x - seasonal - trend AS residual FROM d JOIN s USING (event_type)
        WHERE k = CASE WHEN period > 1 THEN i % period ELSE 0 END)"""


@query("T4_series_decompose", f"""{_PARTS} SELECT event_type, i, period, round(seasonal, 6) AS seasonal, round(trend, 6) AS trend,
    round(residual, 6) AS residual FROM parts""")
def _(t: Tables):
    out = series_decompose(_hourly(t), "x")
    zipped = F.arrays_zip(F.col("x_seasonal").alias("seasonal"), F.col("x_trend").alias("trend"), F.col("x_residual").alias("residual"))
    rows = out.select("event_type", F.col("x_period").cast("long").alias("period"), F.posexplode(zipped).alias("i", "p"))
    return rounded(rows.select("event_type", F.col("i").cast("long").alias("i"), "period", "p.seasonal", "p.trend", "p.residual"),
                   6, "seasonal", "trend", "residual")


@query("T4_decompose_anomalies", f"""{_PARTS} SELECT event_type, TIMESTAMP '{_FROM}' + i * INTERVAL '1 hour' AS ts, x, CASE WHEN score > 1.5 THEN 1 WHEN score < -1.5 THEN -1
    ELSE 0 END AS flag, round(score, 6) AS score, round(seasonal + trend, 6) AS baseline FROM ({_fences('SELECT * FROM parts', 'event_type', 'residual', 0.1, 0.9)})""")
def _(t: Tables):
    scored = series_decompose_anomalies(_hourly(t), "x", 1.5, flag="flag", score="score", baseline="baseline")
    return rounded(expand_series(scored, "ts", "x", "flag", "score", "baseline"), 6, "score", "baseline")
