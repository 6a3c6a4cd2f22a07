"""Positions, trades, costs and equity of signals; their measures; carry; splits and grids."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.dist import deflated_sharpe
from barloom.functions.semantics import KEYS, ORDER, sample_kurtosis, sample_skewness, until_now, whole
from barloom.operators.series import Series
from barloom.operators.signals import SignalConfig, combined, position
from barloom.operators.trend import causal_trends

BARS_A_YEAR = 6048


class CostModel(Protocol):
    """Anything that makes a cost (a fraction of the price) from trades."""

    def compute(self, trade: Column) -> Column: ...


class ZeroCost:
    def compute(self, trade: Column) -> Column:
        return F.lit(0.0)


@dataclass(frozen=True)
class FxCost:
    """Spread and slippage, in basis points of each unit traded."""

    spread_bps: float = 1.0
    slippage_bps: float = 2.0

    def __post_init__(self) -> None:
        if self.spread_bps < 0 or self.slippage_bps < 0:
            raise ValueError("costs can't be negative")

    def compute(self, trade: Column) -> Column:
        return F.abs(trade) * F.lit((self.spread_bps + self.slippage_bps) / 10_000)

    def of(self, size: float, side: str) -> float:
        """The cost of one trade."""
        if size < 0:
            raise ValueError("size can't be negative")
        if side not in ("buy", "sell"):
            raise ValueError(f"side must be buy or sell, not {side!r}")
        return size * (self.spread_bps + self.slippage_bps) / 10_000


@dataclass(frozen=True)
class ArrowCost:
    """A cost model given as a function from a pandas Series of trades to one of costs."""

    function: Callable[[pd.Series], pd.Series]

    def compute(self, trade: Column) -> Column:
        return F.pandas_udf(self.function, "double")(trade)


def cost_from(config: Mapping) -> FxCost:
    """From execution.commission_bps and execution.slippage_bps of a configuration, 1.0 and 2.0 where absent."""
    own = config.get("execution", {})
    return FxCost(float(own.get("commission_bps", 1.0)), float(own.get("slippage_bps", 2.0)))


def checked_input(df: DataFrame, signal: str, keys: Sequence[str], order: str, price: str, rows_needed: bool = False) -> None:
    """Raises ValueError for missing columns (and, with rows_needed, for a table without rows: this reads one row), and
    TypeError for an order that isn't a time, or a price or signal that isn't a number."""
    lacking = [c for c in (signal, price, *keys, order) if c not in df.columns]
    if lacking:
        raise ValueError(f"columns missing: {lacking}")
    if not isinstance(df.schema[order].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        raise TypeError(f"{order} must be a timestamp or a date, not {df.schema[order].dataType.simpleString()}")
    for c in (signal, price):
        if not isinstance(df.schema[c].dataType, T.NumericType):
            raise TypeError(f"{c} must be a number, not {df.schema[c].dataType.simpleString()}")
    if rows_needed and df.isEmpty():
        raise ValueError("no rows to test on")


def backtest(df: DataFrame, signal: str = "signal", cost: CostModel = ZeroCost(), keys: Sequence[str] = KEYS, order: str = ORDER, price: str = "close", rows_needed: bool = False) -> DataFrame:
    """`df` with position (the signal of the row before, 0 at first and for null), trade (its change, 0 at first),
    gross_return, cost, net_return and equity (the running product of 1 + net_return).

    Rows that a slice leaves out must be filtered before: neighbours that are kept count as successive. The input is
    checked as `checked_input` says; without rows_needed an empty table gives an empty one.
    """
    checked_input(df, signal, keys, order, price, rows_needed)
    w = whole(keys, order)
    one = df.withColumns({
        "position": F.coalesce(F.lag(signal).over(w), F.lit(0.0)),
        "_return": F.coalesce(F.try_divide(F.col(price), F.lag(price).over(w)) - 1, F.lit(0.0)),
    })
    two = one.withColumn("trade", F.coalesce(F.col("position") - F.lag("position").over(w), F.lit(0.0)))
    three = two.withColumns({"gross_return": F.col("position") * F.col("_return"), "cost": cost.compute(F.col("trade"))}).drop("_return")
    return three.withColumn("net_return", F.col("gross_return") - F.col("cost")).withColumn("equity", F.product(1 + F.col("net_return")).over(until_now(keys, order)))


def metrics(results: DataFrame, by: Sequence[str], keys: Sequence[str] = KEYS, order: str = ORDER, n_trials: int = 1, year: int = BARS_A_YEAR, least: int = 10) -> DataFrame:
    """One row for each `by`: n_obs, sharpe, annual_return, max_drawdown, n_trades, turnover, costs, pct_positive,
    volatility, skew and kurtosis (of net returns that aren't 0, if there are more than 3), dsr.

    sharpe is mean over sample deviation times the root of `year`; below `least` rows the measures are null. n_trades
    is half the sum of the trades' sizes, rounded down; trade_bars counts bars with a trade. The drawdown is from the
    equity's running maximum.
    """
    peak = F.max("equity").over(until_now((*by, *[k for k in keys if k not in by]), order))
    r = F.col("net_return")
    moved = F.when(r != 0, r)
    n = F.count(r)
    enough = lambda c: F.when(F.col("n_obs") >= least, c)
    out = (
        results.withColumn("_down", F.col("equity") / peak - 1)
        .groupBy(*by)
        .agg(
            n.alias("n_obs"),
            F.avg(r).alias("_mean"),
            F.stddev_samp(r).alias("_std"),
            F.min("_down").alias("_down"),
            F.floor(F.sum(F.abs("trade")) / 2).alias("n_trades"),
            F.count_if(F.col("trade") != 0).alias("trade_bars"),
            F.sum(F.abs("trade")).alias("turnover"),
            F.sum("cost").alias("costs"),
            F.avg((r > 0).cast("double")).alias("pct_positive"),
            sample_skewness(moved).alias("skew"),
            sample_kurtosis(moved).alias("kurtosis"),
        )
        .withColumns({
            "sharpe": enough(F.round(F.try_divide(F.col("_mean"), F.col("_std")) * F.sqrt(F.lit(year)), 4)),
            "annual_return": enough(F.round(F.col("_mean") * year, 6)),
            "max_drawdown": enough(F.round("_down", 6)),
            "volatility": enough(F.col("_std") * F.sqrt(F.lit(year))),
        })
    )

    @F.pandas_udf("double")
    def dsr(sharpe: pd.Series, n: pd.Series, skew: pd.Series, kurtosis: pd.Series) -> pd.Series:
        return pd.Series([
            None if s != s else round(deflated_sharpe(s, int(k), n_trials, 0.0 if g != g else g, 0.0 if q != q else q), 4)
            for s, k, g, q in zip(sharpe, n, skew, kurtosis)
        ], dtype=float)

    return out.withColumn("dsr", dsr(F.col("sharpe"), F.col("n_obs"), F.col("skew"), F.col("kurtosis"))).drop("_mean", "_std", "_down")


def crossed(df: DataFrame, grid: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """Every row with every combination of a parameter grid, which is counted first: above most_rows is an error, so the
    side that is sent to all executors is bounded."""
    if grid.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"the grid has more than {most_rows} rows")
    return df.join(F.broadcast(grid), F.lit(True))


def high_count(results: DataFrame, order: Sequence[str], least: int = 500, nearest: int = 10) -> DataFrame:
    """The combinations of a grid's results (at most as many as `crossed` allows) with at least `least` trades; if there is
    none, the `nearest` ones with most trades, of equal ones the first by `order`. enough says which; place counts from 1, by falling
    Sharpe ratio or number of trades."""
    every = Window.partitionBy(F.lit(1))
    enough = F.col("n_trades") >= least
    ranked = results.withColumn("enough", F.max(enough).over(every))
    first = F.when(F.col("enough"), F.col("sharpe")).otherwise(F.col("n_trades").cast("double"))
    kept = ranked.where(enough | ~F.col("enough")).withColumn("place", F.row_number().over(every.orderBy(first.desc_nulls_last(), *order)))
    return kept.where(F.col("enough") | (F.col("place") <= nearest))


def as_of(df: DataFrame, rates: DataFrame, values: Sequence[str], keys: Sequence[str] = ("symbol",), order: str = ORDER, date: str = "date") -> DataFrame:
    """`df` with the values of its keys' latest rate at or before its time, or of the first rate if there is none.

    A union in order of time with the last rate carried on; one shuffle by key, no join on a range.
    """
    at = lambda c: F.col(c).cast("timestamp_ntz")
    left = df.withColumns({"_at": at(order), "_row": F.lit(1)})
    right = rates.select(*keys, at(date).alias("_at"), F.lit(0).alias("_row"), *[F.col(v) for v in values])
    both = left.drop(*values).unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_at", "_row")
    is_rate = F.col("_row") == 0
    over = f"over (partition by {', '.join(keys)} order by _at, _row)"
    last = {
        v: F.coalesce(
            F.last(F.when(is_rate, F.struct(v)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))[v],
            F.expr(f"lead(case when _row = 0 then `{v}` end, 1) ignore nulls {over}"),
        )
        for v in values
    }
    return both.withColumns(last).where("_row = 1").drop("_at", "_row")


def swap_pnl(df: DataFrame, out: str = "swap_bps", size: float = 1.0) -> DataFrame:
    """The day's rate of the position's side (long_bps, short_bps) for every row with a position, times its size."""
    side = F.when(F.col("position") > 0, F.col("long_bps")).when(F.col("position") < 0, F.col("short_bps"))
    return df.withColumn(out, F.coalesce(side * F.abs("position") * size, F.lit(0.0)))


def triple_roll_days(start: Column, days: Column) -> Column:
    """Two more days for each Wednesday in [start, start + days); without a start two sevenths of the days, rounded to
    the even one at a half."""
    d0 = F.weekday(start)
    exact = 2 * (F.floor((d0 + days + 4) / 7) - F.floor((d0 + 4) / 7))
    return F.when(days <= 0, F.lit(0)).when(start.isNull(), F.bround(days * 2 / F.lit(7.0), 0).cast("bigint")).otherwise(exact)


def swap_cost(rate_bps: Column, size: Column, days: Column, start: Column) -> Column:
    """Rate times size times days, triple rolls included; 0 for no size or no days. Negative sizes or days are null."""
    pnl = rate_bps * size * (days + triple_roll_days(start, days))
    return F.when((size < 0) | (days < 0), F.lit(None)).when((size == 0) | (days == 0), F.lit(0.0)).otherwise(pnl)


def split(df: DataFrame, test_ratio: float = 0.2, gap: int = 0, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """`df` with part: `train`, `gap` (the `gap` rows before the test) or `test` (the last test_ratio of each series)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    first_test = F.floor(n * F.lit(1 - test_ratio)) + 1
    row = F.row_number().over(whole(keys, order))
    out = df.withColumns({"_row": row, "_first": first_test})
    part = F.when(F.col("_row") >= F.col("_first"), "test").when(F.col("_row") >= F.col("_first") - gap, "gap").otherwise("train")
    return out.withColumn("part", part).drop("_row", "_first")


@dataclass(frozen=True)
class MultiFactorConfig:
    hp_lambda: float = 3.9e9
    hp_window: int = 500
    ma_short: int = 72
    ma_long: int = 240
    atr_window: int = 20
    norm_method: str = "zscore"
    norm_window: int = 252 * 24
    norm_least: int = 30
    strength_window: int = 20
    feature_weights: Mapping[str, float] | None = None
    signal_mode: str = "binary_threshold"
    threshold: float = 0.3
    cost: FxCost = field(default_factory=lambda: FxCost(0.7, 0.2))


FACTORS = ("ma_spread_inv", "trend_dev_inv", "crossover", "trend_strength")


def multi_factor(df: DataFrame, config: MultiFactorConfig = MultiFactorConfig(), keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """`df` with the four normalised factors that have a weight, `combined` and `signal` (the position they call for).

    The first three factors revert, so their signs are turned.
    """
    c = config
    trended = causal_trends(df, "close", {"_trend": c.hp_lambda}, c.hp_window, keys, order)
    s = Series(trended, tuple(keys), order).atr("_atr", c.atr_window)
    s = s.ma_spread("_a", "_trend", c.ma_short, c.ma_long, "_atr").deviation_from_ma("_b", "_trend", c.ma_long, "_atr").crossover("_c", "_trend", c.ma_short, c.ma_long)
    s = s.trend_strength("trend_strength", "_trend", "_atr", c.strength_window, c.norm_window, c.norm_least)
    s = s.put(ma_spread_inv=-F.col("_a"), trend_dev_inv=-F.col("_b"), crossover=-F.col("_c"))
    names = [f for f in FACTORS if c.feature_weights is None or f in c.feature_weights]
    s = s.normalised({f"{f}_n": f for f in names}, c.norm_method, c.norm_window, c.norm_least)
    signal = SignalConfig(c.signal_mode, c.threshold, None if c.feature_weights is None else {f"{f}_n": w for f, w in c.feature_weights.items()})
    s = s.put(combined=combined([f"{f}_n" for f in names], signal))
    s = s.put(signal=position(F.col("combined"), c.signal_mode, c.threshold))
    return s.without("_trend", "_atr", "_a", "_b", "_c").df


def multi_factor_backtest(df: DataFrame, config: MultiFactorConfig = MultiFactorConfig(), keys: Sequence[str] = KEYS, order: str = ORDER, year: int = BARS_A_YEAR) -> DataFrame:
    """One row for each series: n_obs, sharpe, annual_return (compounded), max_drawdown, n_trades (bars with a trade)."""
    run = backtest(multi_factor(df, config, keys, order), "signal", config.cost, keys, order)
    peak = F.max("equity").over(until_now(keys, order))
    r = F.col("net_return")
    return run.withColumn("_d", F.col("equity") / peak - 1).groupBy(*keys).agg(
        F.count(r).alias("n_obs"),
        (F.try_divide(F.avg(r), F.stddev_samp(r)) * F.sqrt(F.lit(year))).alias("sharpe"),
        (F.pow(1 + F.avg(r), F.lit(year)) - 1).alias("annual_return"),
        F.min("_d").alias("max_drawdown"),
        F.count_if(F.col("trade") != 0).alias("n_trades"),
    )
