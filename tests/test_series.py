import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from huntframe.operators.aggregates import avg, count, dcount
from huntframe.operators.series import expand_series, make_series, series_anomaly

AS_OF = datetime(2026, 6, 24)


def daily(spark, per_day):
    rows = [("h", AS_OF - timedelta(days=len(per_day) - d, minutes=-k), f"dga{k:03d}") for d, n in enumerate(per_day) for k in range(n)]
    return spark.createDataFrame(rows, "host string, TimeGenerated timestamp, q string")


def test_spike_is_flagged_and_flat_is_not(spark):
    for counts, fires in (([2] * 6 + [40], True), ([2] * 7, False)):
        series = make_series(daily(spark, counts), AS_OF - timedelta(days=7), AS_OF, "P1D", ["host"], n=dcount("q"))
        scored = series_anomaly(series, "n", 1.5)
        rows = expand_series(scored, "TimeGenerated", "n", "AnomalyFlag", "AnomalyScore", "Baseline").collect()
        assert len(rows) == 7 and any(r.AnomalyFlag == 1 for r in rows) is fires
        assert [r.n for r in sorted(rows, key=lambda r: r.TimeGenerated)] == counts


def test_zero_fill_key_out_of_range_and_no_keys(spark):
    df = spark.createDataFrame([("a", datetime(2024, 1, 1, 1), 4.0), ("a", datetime(2024, 1, 3), 6.0), ("b", datetime(2025, 1, 1), 1.0)],
                               "k string, t timestamp, v double")
    got = {r.k: r for r in make_series(df, datetime(2024, 1, 1), datetime(2024, 1, 4), "P1D", ["k"], "t", n=count(), v=avg("v")).collect()}
    assert (got["a"].n, got["a"].v) == ([1, 0, 1], [4.0, 0.0, 6.0])
    assert got["b"].n == [0, 0, 0] and got["b"].t == [datetime(2024, 1, d) for d in (1, 2, 3)]
    one = make_series(df.filter("k = 'none'"), datetime(2024, 1, 1), datetime(2024, 1, 3), "P1D", (), "t", n=count()).collect()
    assert [r.n for r in one] == [[0, 0]]


def test_at_least_one_bucket(spark):
    df = spark.createDataFrame([("a", datetime(2024, 1, 1, 1))], "k string, t timestamp")
    out = make_series(df, datetime(2024, 1, 1), datetime(2024, 1, 1, 2), "P1D", ["k"], "t", n=count()).first()
    assert out.n == [1]


def leave_one_out(values):
    out = []
    for i, x in enumerate(values):
        rest = np.array(values[:i] + values[i + 1:], dtype=float)
        sd = rest.std()
        out.append(((x - rest.mean()) / (sd if sd > 0 else 1e-9), rest.mean()))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_scores_against_numpy(spark, seed):
    rng = random.Random(seed)
    samples = [[rng.gauss(5, 2) for _ in range(20)], [1e6] + [2 + rng.random() * 1e-4 for _ in range(10)],
               [3.0] * 8 + [9.0], [0.0] * 5, [rng.choice([0.0, 1.0]) for _ in range(12)]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(samples)], "id int, v array<double>")
    for r in series_anomaly(df, "v").collect():
        z, mean = zip(*leave_one_out(samples[r.id]))
        assert r.AnomalyScore == pytest.approx(list(z), rel=1e-6)
        assert r.Baseline == pytest.approx(list(mean), rel=1e-9)
        assert r.AnomalyFlag == [1 if s > 1.5 else -1 if s < -1.5 else 0 for s in z]


def test_single_point_has_no_score(spark):
    row = series_anomaly(spark.createDataFrame([([7.0],)], "v array<double>"), "v").first()
    assert (row.AnomalyFlag, row.AnomalyScore, row.Baseline) == ([0], [None], [None])
