import math
from datetime import date, datetime, timedelta

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.functions.dist import deflated_sharpe
from barloom.operators import backtest as bt
from barloom.operators import signals

T = datetime(2024, 1, 1)


def frame(spark, close, signal, symbol="s"):
    return spark.createDataFrame([(symbol, T + timedelta(hours=i), float(c), None if s is None else float(s)) for i, (c, s) in enumerate(zip(close, signal))], "symbol string, ts timestamp_ntz, close double, signal double")


def run(spark, close, signal, cost=bt.ZeroCost()):
    return bt.backtest(frame(spark, close, signal), "signal", cost).orderBy("ts").collect()


@given(st.lists(st.sampled_from([None, -1.0, -0.5, 0.0, 1.0]), min_size=1, max_size=12), st.floats(0.1, 9), st.floats(0.1, 9))
@settings(max_examples=15, deadline=None)
def test_every_unit_of_trade_pays_the_rate(spark, wanted, spread, slippage):
    close = [50 + (7 * i) % 11 for i in range(len(wanted))]
    rows = run(spark, close, wanted, bt.FxCost(spread, slippage))
    held = [0.0, *(x or 0.0 for x in wanted[:-1])]
    for i, r in enumerate(rows):
        moved = held[i] - held[i - 1] if i else 0.0
        assert r.position == held[i] and r.trade == moved and math.isclose(r.cost, abs(moved) * (spread + slippage) * 1e-4)


def test_turning_round_pays_for_both_ways(spark):
    rows = run(spark, [20, 21, 23, 22, 20, 19], [-1, -1, 1, 1, 1, 1], bt.FxCost(2.5, 1.5))
    assert [r.trade for r in rows] == [0, -1, 0, 2, 0, 0]
    assert [round(r.cost, 12) for r in rows] == [0, 4e-4, 0, 8e-4, 0, 0]


def test_no_signal_keeps_the_equity_and_nulls_count_as_flat(spark):
    assert {r.equity for r in run(spark, [1, 2, 3], [0, 0, 0])} == {1.0}
    assert [r.position for r in run(spark, [1, 2, 3], [None, 1, None])] == [0, 0, 1]


def test_equity_is_the_product(spark):
    rows = run(spark, [1.0, 1.1, 0.99, 1.2], [1, 1, -1, 0])
    want, e = [], 1.0
    for r in rows:
        e *= 1 + r.net_return
        want.append(e)
    assert all(math.isclose(a, r.equity) for a, r in zip(want, rows))


def test_columns_are_checked(spark):
    with pytest.raises(ValueError):
        bt.backtest(frame(spark, [1], [1]), "other")
    with pytest.raises(TypeError):
        bt.backtest(frame(spark, [1], [1]).withColumn("ts", F.lit(7)))
    with pytest.raises(TypeError):
        bt.backtest(frame(spark, [1], [1]).withColumn("signal", F.lit("long")))
    none = frame(spark, [1], [1]).where("false")
    with pytest.raises(ValueError):
        bt.backtest(none, rows_needed=True)
    assert bt.backtest(none).count() == 0


def test_costs(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-2.0,), (0.0,), (1.0,)], "t double")
    rate = bt.FxCost(0.4, 0.3)
    assert [round(r[0], 12) for r in df.select(rate.compute(F.col("t"))).collect()] == [7e-5, 0, 14e-5, 0, 7e-5]
    assert bt.cost_from({}) == bt.FxCost(1.0, 2.0) and bt.cost_from({"execution": {"commission_bps": 0.4, "slippage_bps": 0.3}}) == rate
    assert math.isclose(rate.of(2, "buy"), 14e-5)
    for bad in (lambda: bt.FxCost(-1, 0), lambda: rate.of(-1, "buy"), lambda: rate.of(1, "hold")):
        with pytest.raises(ValueError):
            bad()

    def half(t: pd.Series) -> pd.Series:
        return t.abs() / 2

    assert [r[0] for r in df.select(bt.ArrowCost(half).compute(F.col("t"))).collect()] == [0.5, 0, 1, 0, 0.5]


def test_metrics(spark):
    close = [100, 101, 100, 102, 104, 103, 105, 104, 103, 106, 107, 105]
    rows = bt.backtest(frame(spark, close, [1] * 12))
    m = bt.metrics(rows, ("symbol",)).first()
    r = pd.Series([0.0] + [b / a - 1 for a, b in zip(close, close[1:])])
    e = (1 + r).cumprod()
    assert m.n_obs == 12 and m.n_trades == 0 and m.trade_bars == 1
    assert math.isclose(m.sharpe, round(r.mean() / r.std() * math.sqrt(6048), 4))
    assert math.isclose(m.max_drawdown, round((e / e.cummax() - 1).min(), 6))
    moved = r[r != 0]
    assert math.isclose(m.skew, moved.skew()) and math.isclose(m.kurtosis, moved.kurtosis())
    assert math.isclose(m.dsr, round(deflated_sharpe(m.sharpe, 12, 1, moved.skew(), moved.kurtosis()), 4))
    assert bt.metrics(bt.backtest(frame(spark, close[:5], [1] * 5)), ("symbol",)).first().sharpe is None


def test_triple_roll(spark):
    starts = [date(2031, 3, 3) + timedelta(days=k) for k in range(7)]
    cases = [(d, n, 2 * sum((d + timedelta(days=k)).weekday() == 2 for k in range(n))) for d in starts for n in (0, 1, 3, 6, 8, 20, 37)]
    cases += [(None, n, round(2 * n / 7)) for n in range(0, 30, 4)]
    df = spark.createDataFrame(cases, "d date, n int, want int")
    assert all(r[0] == r[1] for r in df.select(bt.triple_roll_days(F.col("d"), F.col("n")).cast("int"), "want").collect())


def test_swap_cost(spark):
    # Of 9 days without a start two or three are extra: 18 / 7 is nearest to 3.
    cases = [(0.25, 2.0, 9, None, 0.25 * 2 * 12), (-1.75, 3.0, 2, date(2031, 3, 4), -1.75 * 3 * 4), (-0.6, 0.0, 4, None, 0.0), (0.9, 2.5, 0, date(2031, 3, 4), 0.0), (0.9, -2.0, 3, None, None), (0.9, 2.0, -3, None, None)]
    df = spark.createDataFrame(cases, "r double, s double, n int, d date, want double")
    got = df.select(bt.swap_cost(F.col("r"), F.col("s"), F.col("n"), F.col("d")), "want").collect()
    assert all(a == b if a is None or b is None else math.isclose(a, b) for a, b in got)


def test_as_of(spark):
    df = frame(spark, [1, 2, 3], [1, -1, 0]).withColumn("position", F.col("signal"))
    rates = spark.createDataFrame([("s", date(2024, 1, 1), 0.5, -1.0), ("z", date(2024, 1, 1), 9.0, 9.0)], "symbol string, date date, long_bps double, short_bps double")
    later = spark.createDataFrame([("s", date(2025, 1, 1), 0.7, -2.0)], rates.schema)
    pnl = lambda x: [r.swap_bps for r in bt.swap_pnl(bt.as_of(df, x, ("long_bps", "short_bps"))).orderBy("ts").collect()]
    assert pnl(rates) == [0.5, -1.0, 0.0] and pnl(later) == [0.7, -2.0, 0.0] and pnl(rates.limit(0)) == [0, 0, 0]


def test_split_and_grids(spark):
    parts = [r.part for r in bt.split(frame(spark, range(1, 11), [0] * 10), 0.2, 2).orderBy("ts").collect()]
    assert parts == ["train"] * 6 + ["gap"] * 2 + ["test"] * 2
    grid = spark.range(5)
    assert bt.crossed(frame(spark, [1, 2], [0, 0]), grid).count() == 10
    with pytest.raises(ValueError):
        bt.crossed(frame(spark, [1], [0]), grid, most_rows=4)


def test_signals(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (-1.0, None), (None, None)], "a double, b double")
    get = lambda c: [r[0] for r in df.select(c).collect()]
    assert get(signals.linear(["a", "b"])) == [1.5, 2.0, -1.0, None]
    assert get(signals.linear(["a", "b"], {"a": -1})) == [-1.0 / -1.0 * 1.0, None, -1.0, None]
    assert get(signals.vote(["a", "b"])) == [1, 1, -1, 0]
    assert get(signals.combined([])) == [None] * 4
    s = signals.linear(["a", "b"])
    assert get(signals.position(s, threshold=1.5)) == [0, 1, 0, 0] and get(signals.position(s, "proportional")) == [1, 1, -1, 0]
    for bad in (lambda: signals.linear(["a"], {"b": 1}), lambda: signals.position(s, "x"), lambda: signals.SignalConfig("x")):
        with pytest.raises(ValueError):
            bad()
