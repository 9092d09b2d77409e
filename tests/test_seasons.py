import random

import numpy as np
import pytest

from huntframe.operators.seasons import series_decompose, series_decompose_anomalies, series_fit_line, series_outliers, series_stats


def _table(spark, series):
    return spark.createDataFrame([(i, s) for i, s in enumerate(series)], "id int, x array<double>")


def _by_id(df):
    return {r.id: r for r in df.collect()}


def _seasonal(rng, n, period, noise=0.0, slope=0.0):
    return [float(10 * np.sin(2 * np.pi * i / period) + slope * i + rng.gauss(0, noise)) if noise else float(i % period == 2) * 8 + slope * i for i in range(n)]


def _brute(x, period=None, least=0.3, longest=None):
    x = np.array(x, float)
    n, i = len(x), np.arange(len(x))
    a, b = np.polyfit(i, x, 1) if n > 1 else (0.0, x[0])
    rest = x - (a * i + b)
    if period is None:
        whole = (rest ** 2).sum()
        r = {k: (rest[:n - k] * rest[k:]).sum() / whole for k in range(1, n // 2 + 2)} if n >= 4 and whole > 0 else {}
        peaks = [(r[k], -k) for k in range(2, min(n // 2, longest or n) + 1) if k in r and k + 1 in r and r[k] > r[k - 1] and r[k] >= r[k + 1] and r[k] >= least]
        period = -max(peaks)[1] if peaks else 0
    medians = np.array([np.median(rest[k::period]) for k in range(min(period, n))]) if period > 1 else np.zeros(1)
    seasonal = (medians - medians.mean())[i % len(medians)]
    return period, seasonal, a * i + b


def test_stats_lines_and_fences(spark):
    rng = random.Random(2)
    series = [[rng.choice([1.0, 2.0, 5.0, 9.0]) for _ in range(n)] for n in (1, 2, 5, 30)] + [[3.0] * 6]
    odd = [[], [None], [None, 4.0, None, 4.0], None]
    stats = _by_id(series_stats(_table(spark, series + odd), "x", "s"))
    for i, x in enumerate(series):
        r = stats[i]
        assert (r.s_min, r.s_min_idx, r.s_max, r.s_max_idx) == (min(x), x.index(min(x)), max(x), x.index(max(x)))
        assert r.s_avg == pytest.approx(np.mean(x))
        assert r.s_variance == (pytest.approx(np.var(x, ddof=1)) if len(x) > 1 else None)
    assert [tuple(stats[len(series) + k])[2:] for k in (0, 1, 3)] == [(None,) * 7] * 3
    assert tuple(stats[len(series) + 2])[2:6] == (4.0, 1, 4.0, 1)

    lines = _by_id(series_fit_line(_table(spark, series + [[]]), "x"))
    for i, x in enumerate(series[1:], 1):
        a, b = np.polyfit(range(len(x)), x, 1)
        assert (lines[i].slope, lines[i].intercept) == (pytest.approx(a, abs=1e-9), pytest.approx(b))
        assert lines[i].line_fit == [pytest.approx(b + a * k) for k in range(len(x))]
    assert lines[0].slope == 0 and lines[len(series)].slope is None and lines[4].rsquare is None

    for low, high in ((10, 90), (25, 75)):
        scored = _by_id(series_outliers(_table(spark, series + odd), "x", "s", low, high))
        for i, x in enumerate(series):
            lo, hi = np.percentile(x, [low, high])
            wide = hi - lo if hi > lo else 1e-9
            assert scored[i].s == [pytest.approx((v - hi) / wide if v > hi else (v - lo) / wide if v < lo else 0.0) for v in x]
        assert [scored[len(series) + k].s for k in range(4)] == [[], [None], [None, 0.0, None, 0.0], None]
    with pytest.raises(ValueError):
        series_outliers(_table(spark, series), "x", low=90, high=10)


def test_seasons_against_numpy(spark):
    rng = random.Random(4)
    series = [_seasonal(rng, 60, 7), _seasonal(rng, 96, 24, 1.0, 0.1), _seasonal(rng, 50, 12, 2.0), [rng.gauss(0, 1) for _ in range(40)],
              [1.0], [1.0, 2.0], [1.0, 2.0, 3.0], [2.0] * 9, [float(k) for k in range(20)], [0.0, 5.0] * 10]
    for options in ({}, {"longest": 10}, {"period": 5}, {"period": 0}, {"least": 0.9}):
        got = _by_id(series_decompose(_table(spark, series), "x", **options))
        for i, x in enumerate(series):
            if np.ptp(np.array(x) - np.poly1d(np.polyfit(range(len(x)), x, 1) if len(x) > 1 else [x[0]])(range(len(x)))) < 1e-9 and "period" not in options:
                continue  # nothing but rounding is left to look for a period in
            period, seasonal, trend = _brute(x, **options)
            r = got[i]
            assert r.x_period == period, (options, i)
            assert r.x_seasonal == [pytest.approx(s, abs=1e-9) for s in seasonal]
            assert r.x_trend == [pytest.approx(s, abs=1e-9) for s in trend]
            assert r.x_residual == [pytest.approx(v, abs=1e-9) for v in np.array(x) - seasonal - trend]
    assert _by_id(series_decompose(_table(spark, [[], None]), "x"))[0].x_period is None
    with pytest.raises(ValueError):
        series_decompose(_table(spark, series), "x", period=-1)


def test_a_peak_of_the_season_is_no_anomaly(spark):
    rng = random.Random(1)
    x = [50.0 * (k % 24 == 9) + rng.gauss(10, 1) for k in range(24 * 10)]
    x[100] += 30
    x[180] -= 30
    r = _by_id(series_decompose_anomalies(_table(spark, [x]), "x", 1.5))[0]
    assert [k for k, f in enumerate(r.AnomalyFlag) if f] == [100, 180]
    assert (r.AnomalyFlag[100], r.AnomalyFlag[180]) == (1, -1)
    assert len(r.Baseline) == len(r.AnomalyScore) == len(x)
