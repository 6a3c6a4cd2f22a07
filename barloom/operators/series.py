"""Features of a series: returns, volatility, averages, ranks and regimes over rolling windows.

A `Series` is a DataFrame with its keys and order. Each method adds one column and returns a new Series; the columns of
one chain share one exchange and one sort, since all windows are partitioned and ordered alike. Windows of many rows
are evaluated row by row; see `ranks` for the long rank windows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.semantics import KEYS, ORDER, at_least, last_rows, rolled, until_now, whole
from barloom.operators.scan import scanned


@dataclass(frozen=True)
class Series:
    df: DataFrame
    keys: tuple[str, ...] = KEYS
    order: str = ORDER

    # -- means

    def put(self, **columns: Column) -> Series:
        return Series(self.df.withColumns(columns), self.keys, self.order)

    def then(self, f: Callable[[DataFrame], DataFrame]) -> Series:
        return Series(f(self.df), self.keys, self.order)

    def without(self, *columns: str) -> Series:
        return Series(self.df.drop(*columns), self.keys, self.order)

    def before(self, x: Column | str, n: int = 1) -> Column:
        return F.lag(x, n).over(whole(self.keys, self.order))

    def after(self, x: Column | str, n: int = 1) -> Column:
        return F.lead(x, n).over(whole(self.keys, self.order))

    def roll(self, x: str, n: int, how: str, least: int | None = None) -> Column:
        return rolled(F.col(x), n, how, self.keys, self.order, least)

    def _log(self, x: str) -> Column:
        return F.when(F.col(x) > 0, F.ln(x))

    # -- returns

    def log_return(self, out: str, price: str = "close") -> Series:
        return self.put(**{out: self._log(price) - self.before(self._log(price))})

    def simple_return(self, out: str, price: str = "close") -> Series:
        return self.put(**{out: F.try_divide(F.col(price), self.before(price)) - 1})

    def momentum(self, out: str, price: str = "close", period: int = 10) -> Series:
        return self.put(**{out: self._log(price) - self.before(self._log(price), period)})

    def forward_return(self, out: str, horizon: int, price: str = "close") -> Series:
        """ln of the price `horizon` rows on over the price."""
        return self.put(**{out: F.ln(F.try_divide(self.after(price, horizon), F.when(F.col(price) > 0, F.col(price))))})

    def forward_sum(self, out: str, horizon: int, log_return: str, scan_offset: bool = False) -> Series:
        """Sum of the next `horizon` log returns; null if one is missing. scan_offset: of those `horizon` to
        2 * horizon - 1 rows on, as one scan to match has it."""
        first = horizon if scan_offset else 1
        w = whole(self.keys, self.order).rowsBetween(first, first + horizon - 1)
        return self.put(**{out: at_least(horizon, F.col(log_return), w, F.sum(log_return).over(w))})

    # -- volatility and normalisation

    def volatility(self, out: str, returns: str, n: int = 20) -> Series:
        return self.put(**{out: self.roll(returns, n, "std")})

    def zscore(self, out: str, x: str, n: int = 20, least: int | None = None) -> Series:
        return self.put(**{out: F.try_divide(F.col(x) - self.roll(x, n, "mean", least), self.roll(x, n, "std", least))})

    def over_std(self, out: str, x: str, lookback: int) -> Series:
        """x over its rolling sample deviation, of at least half the lookback."""
        return self.put(**{out: F.try_divide(F.col(x), self.roll(x, lookback, "std", lookback // 2))})

    def vol_zscore(self, out: str, returns: str, n: int = 20, lookback: int = 6048, least: int = 30) -> Series:
        return self.volatility("_v", returns, n).zscore(out, "_v", lookback, least).without("_v")

    # -- ranges

    def bar_range(self, out: str) -> Series:
        return self.put(**{out: F.col("high") - F.col("low")})

    def close_position(self, out: str) -> Series:
        """Where in the bar's range the close lies, 0 to 1; null for a bar without a range."""
        return self.put(**{out: F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low"))})

    def true_range(self, out: str) -> Series:
        """The first row, without a close before it, has high - low."""
        c = self.before("close")
        return self.put(**{out: F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - c), F.abs(F.col("low") - c))})

    def atr(self, out: str, n: int = 20) -> Series:
        s = self.true_range("_tr")
        return s.put(**{out: s.roll("_tr", n, "mean")}).without("_tr")

    def spread_ratio(self, out: str, atr: str, n: int = 20) -> Series:
        """Rolling mean of range over ATR, of whatever rows there are."""
        x = F.try_divide(F.col("high") - F.col("low"), F.col(atr))
        return self.put(**{out: F.avg(x).over(last_rows(n, self.keys, self.order))})

    # -- averages

    def sma(self, out: str, x: str, n: int) -> Series:
        return self.put(**{out: self.roll(x, n, "mean")})

    def ema(self, out: str, x: str, span: int) -> Series:
        """Exponential mean, weight 2 / (span + 1), from the first value on; a null keeps the mean, and the weight of
        what came before it decays on."""
        return Series(scanned(self.df, self.keys, self.order, _ema(x, out, 2 / (span + 1)), {out: "double"}), self.keys, self.order)

    def envelope(self, out: str, x: str, n: int, pct: float) -> Series:
        """<out>_mid, <out>_upper and <out>_lower."""
        mid = self.roll(x, n, "mean")
        return self.put(**{f"{out}_mid": mid, f"{out}_upper": mid * (1 + pct / 100), f"{out}_lower": mid * (1 - pct / 100)})

    def distance_from_ma(self, out: str, x: str, n: int = 20) -> Series:
        """Deviation from the rolling mean over the rolling deviation of that deviation."""
        s = self.put(_d=F.col(x) - self.roll(x, n, "mean"))
        return s.put(**{out: F.try_divide(F.col("_d"), s.roll("_d", n, "std"))}).without("_d")

    def rsi(self, out: str, x: str, n: int = 14) -> Series:
        """Relative strength by simple means: 100 without losses, null without any change."""
        s = self.put(_c=F.col(x) - self.before(x))
        s = s.put(_g=F.when(F.col("_c").isNotNull(), F.greatest("_c", F.lit(0.0))), _l=F.when(F.col("_c").isNotNull(), F.greatest(-F.col("_c"), F.lit(0.0))))
        g, lo = s.roll("_g", n, "mean"), s.roll("_l", n, "mean")
        s = s.put(_g=g, _l=lo)
        strength = F.when((F.col("_l") == 0) & (F.col("_g") > 0), F.lit(100.0)).otherwise(100 - 100 / (1 + F.try_divide(F.col("_g"), F.col("_l"))))
        return s.put(**{out: strength}).without("_c", "_g", "_l")

    def ma_spread(self, out: str, x: str, fast: int, slow: int, atr: str | None = None) -> Series:
        """Difference of two means, over ATR if given (null where that is 0)."""
        if slow <= fast:
            raise ValueError("slow must be above fast")
        d = self.roll(x, fast, "mean") - self.roll(x, slow, "mean")
        return self.put(**{out: F.try_divide(d, F.col(atr)) if atr else d})

    def crossover(self, out: str, x: str, fast: int, slow: int) -> Series:
        """1.0 where the fast mean is above the slow one, else -1.0; null before there are both."""
        s = self.ma_spread("_s", x, fast, slow)
        return s.put(**{out: F.when(F.col("_s") > 0, 1.0).when(F.col("_s").isNotNull(), -1.0)}).without("_s")

    def crossover_age(self, out: str, x: str, fast: int, slow: int) -> Series:
        """Rows with both means since the sign of their difference last changed; 0 at a change and at the first such row."""
        s = self.ma_spread("_s", x, fast, slow).put(_g=F.signum("_s"))
        valid = F.col("_g").isNotNull()
        w = until_now(s.keys, s.order)
        s = s.put(_n=F.count("_g").over(w), _p=F.last(F.col("_g"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        s = s.put(_m=F.when(valid & (F.col("_p").isNull() | (F.col("_p") != F.col("_g"))), F.col("_n")))
        return s.put(**{out: F.when(valid, F.col("_n") - F.last("_m", ignorenulls=True).over(w))}).without("_s", "_g", "_n", "_p", "_m")

    def deviation_from_ma(self, out: str, x: str, n: int, atr: str) -> Series:
        return self.put(**{out: F.try_divide(F.col(x) - self.roll(x, n, "mean"), F.col(atr))})

    # -- trends

    def slope(self, out: str, x: str) -> Series:
        return self.put(**{out: F.col(x) - self.before(x)})

    def curvature(self, out: str, x: str) -> Series:
        return self.put(**{out: F.col(x) - 2 * self.before(x) + self.before(x, 2)})

    def disagreement(self, out: str, trends: Sequence[str], atr: str | None = None) -> Series:
        """Sample deviation of several trends' slopes at each row, nulls left out, over ATR if given."""
        if len(trends) < 2:
            raise ValueError("two trends at least")
        s = self.put(_a=F.array_compact(F.array(*[F.col(t) - self.before(t) for t in trends])))
        n = F.size("_a")
        mean = F.aggregate("_a", F.lit(0.0), lambda a, v: a + v) / n
        square = F.aggregate("_a", F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
        std = F.when(n > 1, F.sqrt(square / (n - 1)))
        return s.put(**{out: F.try_divide(std, F.col(atr)) if atr else std}).without("_a")

    def trend_consistency(self, out: str, slope: str, n: int = 48, least: int = 10) -> Series:
        """Share of the window's slopes with the sign of its last one; null if that sign is 0."""
        w = last_rows(n, self.keys, self.order)
        sign = F.signum(slope)
        last = F.last(sign, ignorenulls=True).over(w)
        up, down, all_ = F.count_if(sign > 0).over(w), F.count_if(sign < 0).over(w), F.count(slope).over(w)
        share = F.when(last > 0, up).when(last < 0, down) / all_
        return self.put(**{out: F.when(all_ >= least, share)})

    # -- ranks and regimes

    def vol_regime(self, out: str, returns: str, n: int = 20, window: int = 252) -> Series:
        """0.0, 1.0 or 2.0: below the 33rd, between, or at or above the 67th percentile of the window's volatilities."""
        s = self.volatility("_v", returns, n)
        w = last_rows(window, s.keys, s.order)
        q = lambda p: at_least(window, F.col("_v"), w, F.percentile("_v", p).over(w))
        s = s.put(_a=q(0.33), _b=q(0.67))
        there = F.col("_v").isNotNull() & F.col("_a").isNotNull()
        regime = F.when(there & (F.col("_v") < F.col("_a")), 0.0).when(there & (F.col("_v") >= F.col("_b")), 2.0).when(there, 1.0)
        return s.put(**{out: regime}).without("_v", "_a", "_b")

    def rank(self, out: str, x: str, n: int, least: int, ties: str = "max") -> Series:
        """Share of the window's values at or below (`max`), or with ties at their mean rank (`mean`), a probe: for
        `max` the window's last value, for `mean` the row's own, so null where that is."""
        return Series(scanned(self.df, self.keys, self.order, _ranks(x, out, n, least, ties), {out: "double"}), self.keys, self.order)

    def vol_percentile(self, out: str, returns: str, n: int = 20, lookback: int = 6048) -> Series:
        s = self.volatility("_v", returns, n).rank("_r", "_v", lookback, lookback, "mean")
        return s.put(**{out: F.col("_r") * 100}).without("_v", "_r")

    def trend_strength(self, out: str, trend: str, atr: str, n: int = 20, lookback: int = 6048, least: int = 30) -> Series:
        """Rank from 0 to 100 of the trend's absolute change over n rows, in ATR."""
        s = self.put(_x=F.try_divide(F.abs(F.col(trend) - self.before(trend, n)), F.col(atr))).rank("_r", "_x", lookback, least)
        return s.put(**{out: F.col("_r") * 100}).without("_x", "_r")

    def normalised(self, features: Mapping[str, str], method: str, n: int = 6048, least: int = 30) -> Series:
        """Adds for each out -> feature its rolling `zscore` or `rank`."""
        s = self
        for out, x in features.items():
            if method == "zscore":
                s = s.zscore(out, x, n, least)
            elif method == "rank":
                s = s.rank(out, x, n, least)
            else:
                raise ValueError(f"unknown method {method!r}")
        return s


def _ema(x: str, out: str, alpha: float):
    def step(block: dict[str, np.ndarray], state: dict) -> dict[str, np.ndarray]:
        values = block[x]
        result = np.full(len(values), np.nan)
        mean, weight = state.get("mean", np.nan), state.get("weight", 1.0)
        for i, v in enumerate(values.tolist()):
            if mean != mean:
                mean = v
            else:
                weight *= 1 - alpha
                if v == v:
                    mean, weight = (weight * mean + alpha * v) / (weight + alpha), 1.0
            result[i] = mean
        state.update(mean=mean, weight=weight)
        return {out: result}

    return step


def _ranks(x: str, out: str, n: int, least: int, ties: str):
    """Keeps the last n - 1 values as state, so that memory is a window and a batch."""

    def step(block: dict[str, np.ndarray], state: dict) -> dict[str, np.ndarray]:
        kept = state.get("kept", np.zeros(0))
        values = np.concatenate((kept, block[x]))
        result = np.full(len(block[x]), np.nan)
        pad = np.concatenate((np.full(max(0, n - 1 - len(kept)), np.nan), values))
        windows = np.lib.stride_tricks.sliding_window_view(pad, n)
        for at in range(0, len(result), max(1, 4_000_000 // n)):
            part = windows[at : at + max(1, 4_000_000 // n)]
            there = ~np.isnan(part)
            count = there.sum(1)
            if ties == "mean":
                probe = part[:, -1]
            else:
                last = n - 1 - there[:, ::-1].argmax(1)
                probe = part[np.arange(len(part)), last]
            with np.errstate(invalid="ignore"):
                below, same = (part < probe[:, None]).sum(1), (part == probe[:, None]).sum(1)
                rank = below + ((same + 1) / 2 if ties == "mean" else same)
                result[at : at + len(part)] = np.where((count >= max(least, 1)) & ~np.isnan(probe), rank / np.maximum(count, 1), np.nan)
        state["kept"] = values[max(0, len(values) - (n - 1)) :] if n > 1 else np.zeros(0)
        return {out: result}

    return step
