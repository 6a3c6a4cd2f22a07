from datetime import datetime, timedelta

import numpy as np
import pytest

from barloom.operators.trend import causal_trends, endpoint_weights, two_sided_trend

T = datetime(2024, 1, 1)


def frame(spark, prices, symbol="s"):
    return spark.createDataFrame([(symbol, T + timedelta(hours=i), None if p is None else float(p)) for i, p in enumerate(prices)], "symbol string, ts timestamp_ntz, close double")


def dense(y, lam):
    n = len(y)
    k = np.zeros((n - 2, n))
    for i in range(n - 2):
        k[i, i : i + 3] = 1, -2, 1
    return np.linalg.solve(np.eye(n) + lam * k.T @ k, y)


@pytest.mark.parametrize("lam", [1e2, 1e4, 1e6])
def test_weights_are_the_last_row_of_the_solution(lam):
    w = np.array(endpoint_weights(lam, 40))
    y = np.random.default_rng(1).normal(150, 1, 40)
    assert abs(w.sum() - 1) < 1e-12
    assert abs(w @ np.arange(40.0) - 39) < 1e-9
    assert abs(w @ y - dense(y, lam)[-1]) < 1e-6


def test_short_windows_are_an_error():
    with pytest.raises(ValueError):
        endpoint_weights(1e4, 9)


def test_causal_trend_with_gaps(spark):
    prices = (100 + np.random.default_rng(2).normal(0, 1, 25).cumsum()).tolist()
    prices[12] = None
    got = [r.t for r in causal_trends(frame(spark, prices), "close", {"t": 1e6}, 10).orderBy("ts").collect()]
    filled = [*prices[:12], prices[11], *prices[13:]]
    assert got[:9] == [None] * 9
    for i in range(9, 25):
        assert abs(got[i] - dense(np.array(filled[i - 9 : i + 1]), 1e6)[-1]) < 1e-5
    rows = causal_trends(frame(spark, prices), "close", {"t": 1e6}, 10).orderBy("ts").collect()
    assert rows[12].close is None


def test_windows_with_leading_nulls_have_no_trend(spark):
    got = [r.t for r in causal_trends(frame(spark, [None, None, *range(13)]), "close", {"t": 1e4}, 10).orderBy("ts").collect()]
    assert got[:11] == [None] * 11
    assert all(abs(v - (i - 2)) < 1e-9 for i, v in enumerate(got) if i >= 11)


@pytest.mark.parametrize("rows", [1, 7, 30, 1000])
def test_stretches_equal_the_whole(spark, rows):
    prices = (100 + np.random.default_rng(3).normal(0, 1, 90).cumsum()).tolist()
    prices[40] = prices[0] = None
    prices[50:77] = [None] * 27  # longer than a window and several stretches
    df = frame(spark, prices).union(frame(spark, prices[:20], "t")).union(frame(spark, [], "u"))
    lambdas = {"a": 1e3, "b": 1e5}
    key = lambda d: {(r.symbol, r.ts): (r.close, r.a and round(r.a, 9), r.b and round(r.b, 9)) for r in d.collect()}
    assert key(causal_trends(df, "close", lambdas, 12, stretch_rows=rows)) == key(causal_trends(df, "close", lambdas, 12))


def test_no_look_ahead(spark):
    prices = list(range(30))
    a = [r.t for r in causal_trends(frame(spark, prices), "close", {"t": 1e4}, 10).orderBy("ts").collect()]
    b = [r.t for r in causal_trends(frame(spark, [*prices[:-1], 99]), "close", {"t": 1e4}, 10).orderBy("ts").collect()]
    assert a[:-1] == b[:-1] and a[-1] != b[-1]


def test_two_sided(spark):
    y = 100 + np.random.default_rng(4).normal(0, 1, 60).cumsum()
    rows = two_sided_trend(frame(spark, y.tolist()), "close", 14400.0).orderBy("ts").collect()
    np.testing.assert_allclose([r.trend for r in rows], dense(y, 14400.0), atol=1e-8)
    np.testing.assert_allclose([r.cycle + r.trend for r in rows], y)
