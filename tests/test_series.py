import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators.series import Series

T = datetime(2024, 1, 1)


def bars(spark, close, high=None, low=None, symbol="s"):
    high = high or [None if c is None else c + 0.5 for c in close]
    low = low or [None if c is None else c - 0.5 for c in close]
    rows = [(symbol, T + timedelta(hours=i), None if c is None else float(c), None if h is None else float(h), None if v is None else float(v)) for i, (c, h, v) in enumerate(zip(close, high, low))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, high double, low double")


def column(s, name):
    return [r[0] for r in s.df.orderBy("symbol", "ts").select(name).collect()]


def walk(n, seed=42):
    r = random.Random(seed)
    out = [100.0]
    for _ in range(n - 1):
        out.append(out[-1] + r.gauss(0, 1))
    return out


def same(a, b, tolerance=1e-9):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        y = None if y is None or y != y else y
        assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=tolerance, abs_tol=1e-12)), (a, b)


def test_short_lists(spark):
    s = Series(bars(spark, [100, 101, 102, 103, 104]))
    same(column(s.momentum("m", period=2), "m"), [None, None, *[math.log((102 + i) / (100 + i)) for i in range(3)]])
    same(column(s.log_return("r"), "r"), [None, *[math.log((101 + i) / (100 + i)) for i in range(4)]])
    same(column(s.simple_return("r"), "r"), [None, *[1 / (100 + i) for i in range(4)]])
    same(column(s.volatility("v", "close", 3), "v"), [None, None, 1.0, 1.0, 1.0])
    same(column(s.forward_return("f", 2), "f"), [*[math.log((102 + i) / (100 + i)) for i in range(3)], None, None])


def test_true_range_begins_with_the_range(spark):
    s = Series(bars(spark, [101, 109], [102, 110], [100, 108])).true_range("t").atr("a", 2).close_position("p")
    assert column(s, "t") == [2.0, 9.0] and column(s, "a") == [None, 5.5] and column(s, "p") == [0.5, 0.5]


def test_close_position_without_a_range_and_constant_prices(spark):
    s = Series(bars(spark, [10.0] * 6, [10.0] * 6, [10.0] * 6)).close_position("p").zscore("z", "close", 3).rsi("r", "close", 3).distance_from_ma("d", "close", 2)
    for c in "pzrd":
        assert column(s, c) == [None] * 6


def test_rsi_bounds_and_no_losses(spark):
    values = [v for v in column(Series(bars(spark, walk(60))).rsi("r", "close"), "r") if v is not None]
    assert len(values) == 46 and all(0 <= v <= 100 for v in values)
    assert column(Series(bars(spark, [1, 2, 3, 4])).rsi("r", "close", 3), "r") == [None, None, None, 100.0]


def test_against_pandas(spark):
    close = walk(80)
    close[10] = None
    p = pd.Series([np.nan if c is None else c for c in close])
    s = Series(bars(spark, close))
    same(column(s.ema("e", "close", 5), "e"), p.ewm(span=5, adjust=False).mean().tolist())
    same(column(s.zscore("z", "close", 20, 5), "z"), ((p - p.rolling(20, min_periods=5).mean()) / p.rolling(20, min_periods=5).std()).tolist())
    same(column(s.rank("r", "close", 20, 20, "mean"), "r"), p.rolling(20).rank(pct=True).tolist())
    d = p - p.rolling(6).mean()
    same(column(s.distance_from_ma("d", "close", 6), "d"), (d / d.rolling(6).std()).tolist())
    assert column(Series(bars(spark, [1, None, 4])).ema("e", "close", 3), "e") == pd.Series([1, np.nan, 4]).ewm(span=3, adjust=False).mean().tolist()


def test_rank_probes_the_last_value_there_is(spark):
    s = Series(bars(spark, [3, 1, None, 2, 5])).rank("r", "close", 3, 2)
    same(column(s, "r"), [None, 0.5, 0.5, 1.0, 1.0])


def test_crossover_and_its_age(spark):
    close = [1, 2, 3, 4, 3, 2, 1, 0, 1, 3, 6]
    s = Series(bars(spark, close)).crossover("x", "close", 1, 3).crossover_age("a", "close", 1, 3)
    assert column(s, "x") == [None, None, 1, 1, -1, -1, -1, -1, 1, 1, 1]
    assert column(s, "a") == [None, None, 0, 1, 0, 1, 2, 3, 0, 1, 2]


def test_errors(spark):
    s = Series(bars(spark, [1, 2]))
    with pytest.raises(ValueError):
        s.ma_spread("x", "close", 5, 5)
    with pytest.raises(ValueError):
        s.disagreement("x", ["close"])
    with pytest.raises(ValueError):
        s.normalised({"x": "close"}, "other")


def all_causal(df):
    s = Series(df).log_return("lr").simple_return("sr").momentum("mom").volatility("rv", "lr", 5).zscore("z", "close", 5).atr("atr", 5).spread_ratio("hs", "atr", 5).sma("sma", "close", 4)
    s = s.ema("ema", "close", 4).envelope("env", "close", 4, 2.0).distance_from_ma("dist", "close", 4).rsi("rsi", "close", 4).crossover("xo", "close", 2, 4).crossover_age("age", "close", 2, 4)
    s = s.deviation_from_ma("td", "close", 4, "atr").slope("sl", "close").curvature("cv", "close").trend_consistency("tc", "sl", 5, 2).vol_regime("reg", "lr", 4, 8).rank("rk", "close", 8, 3)
    s = s.vol_percentile("vp", "lr", 4, 8).trend_strength("tst", "close", "atr", 3, 8, 3).over_std("os", "close", 6).vol_zscore("vz", "lr", 4, 8, 3).disagreement("ls", ["close", "sma"])
    return s.df


def test_no_feature_looks_ahead(spark):
    close = walk(40)
    a = all_causal(bars(spark, close)).orderBy("ts").toPandas()
    b = all_causal(bars(spark, [*close[:-1], 500.0])).orderBy("ts").toPandas()
    pd.testing.assert_frame_equal(a.iloc[:-1], b.iloc[:-1])
    assert (a.iloc[-1] != b.iloc[-1]).any()


def test_series_do_not_mix_and_share_one_exchange(spark):
    two = bars(spark, walk(30)).union(bars(spark, walk(30, 7), symbol="t"))
    alone = all_causal(bars(spark, walk(30, 7), symbol="t")).orderBy("ts").toPandas()
    pd.testing.assert_frame_equal(all_causal(two).where(F.col("symbol") == "t").orderBy("ts").toPandas(), alone)
    windows = Series(two).log_return("lr").volatility("rv", "lr", 5).atr("atr", 5).sma("m", "close", 4).df
    assert windows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("rows", [3, 11, 500])
def test_features_over_stretches_equal_those_over_series(spark, rows):
    from barloom.operators.scan import by_stretch

    two = bars(spark, walk(50)).union(bars(spark, walk(35, 7), symbol="t"))

    def make(df, keys=("symbol",)):
        return Series(df, keys).log_return("lr").zscore("z", "lr", 6, 3).atr("a", 5).crossover("x", "close", 2, 6).rank("r", "close", 7, 2).df

    def rounded(df):
        return {(r.symbol, r.ts): tuple(None if v is None else round(v, 9) for v in (r.lr, r.z, r.a, r.x, r.r)) for r in df.collect()}

    assert rounded(by_stretch(two, ("symbol",), "ts", rows, 8, make)) == rounded(make(two))
