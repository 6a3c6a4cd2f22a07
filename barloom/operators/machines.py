"""Entry and exit signals with memory, and the gates on them.

The two threshold machines jump from event to event: which rows lie beyond the thresholds is found for a whole block at
once, and a position's end is the earlier of the next opposite row and the first usable row after its time is up.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.semantics import rolled, until_now
from barloom.operators.scan import scanned


def _sides(x: np.ndarray, spread: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are usable, and on which side of the thresholds they lie (1, -1, 0 between)."""
    usable = ~(np.isnan(x) | np.isnan(spread) | (spread == 0))
    with np.errstate(invalid="ignore"):
        side = np.where(usable, (x > sigma * spread).astype(int) - (x < -sigma * spread).astype(int), 0)
    return usable, side


def _next(where: np.ndarray, at: int) -> int:
    """The first of sorted rows that isn't before `at`; far away if there is none."""
    i = np.searchsorted(where, at)
    return int(where[i]) if i < len(where) else 1 << 60


def _play(n: int, usable: np.ndarray, side: np.ndarray, hold: int, state: dict, entry) -> np.ndarray:
    """Positions of a block. entry(at) -> (row, direction) of the first entry at or after a row; state: open position
    as direction and rows since it was opened, or the row from which entries count."""
    can, high, low = np.flatnonzero(usable), np.flatnonzero(side == 1), np.flatnonzero(side == -1)
    signal = np.zeros(n)
    direction, opened, free = state.get("direction", 0), -state.get("age", 0), -state.get("free", 0)
    at = 0
    while True:
        if direction == 0:
            opened, direction = entry(free)
            if opened >= n:
                direction = 0
                break
            at = opened
            begin = opened + 1
        else:
            begin = max(at, 0)
        stop = min(_next(high if direction == 1 else low, begin), _next(can, max(begin, opened + hold)))
        signal[max(at, 0) : min(stop, n)] = direction
        if stop >= n:
            break
        direction, free, at = 0, stop + 1, stop + 1
    state["direction"], state["age"], state["free"] = direction, n - opened if direction else 0, n - free
    return signal


def crossing_step(x: str, spread: str, sigma: str, hold: str, out: str):
    """Entries only where a row newly lies beyond a threshold: the usable row before lay elsewhere."""

    def step(block: dict[str, np.ndarray], state: dict) -> dict[str, np.ndarray]:
        usable, side = _sides(block[x], block[spread], block[sigma])
        n = len(side)
        can = np.flatnonzero(usable)
        seen = side[can]
        before = np.concatenate(([state.get("side", 0)], seen[:-1])) if len(can) else seen
        fresh = can[(seen != 0) & (seen != before)]

        def entry(at: int) -> tuple[int, int]:
            row = _next(fresh, at)
            return row, -int(side[row]) if row < n else 0

        signal = _play(n, usable, side, int(block[hold][0]), state, entry)
        if len(can):
            state["side"] = int(seen[-1])
        return {out: signal}

    return step


def residency_step(x: str, spread: str, sigma: str, hold: str, confirm: str, out: str):
    """Entries after more than `confirm` successive usable rows beyond the same threshold, counted while flat."""

    def step(block: dict[str, np.ndarray], state: dict) -> dict[str, np.ndarray]:
        usable, side = _sides(block[x], block[spread], block[sigma])
        n, need = len(side), int(block[confirm][0])
        change = np.flatnonzero(np.diff(side)) + 1
        starts = np.concatenate(([0], change))
        stops = np.concatenate((change, [n]))
        kinds = side[starts]
        # A run may have begun in blocks before.
        held_side, held = state.get("run", (0, 0))
        starts = starts.astype(np.int64)
        if kinds[0] and kinds[0] == held_side:
            starts[0] = -held
        runs = np.flatnonzero(kinds)

        def entry(at: int) -> tuple[int, int]:
            for r in runs[np.searchsorted(stops[runs], at, "right") :].tolist():
                row = max(int(starts[r]), at) + need
                if row < stops[r]:
                    return max(row, 0), -int(kinds[r])
            return 1 << 60, 0

        signal = _play(n, usable, side, int(block[hold][0]), state, entry)
        state["run"] = (int(kinds[-1]), int(n - starts[-1])) if kinds[-1] else (0, 0)
        return {out: signal}

    return step


def threshold_signals(df: DataFrame, x: str, out: str, sigma: Column | float, hold: Column | int, confirm: Column | int = 0, lookback: int = 6048, crossing: bool = False, keys: Sequence[str] = ("symbol",), order: str = "ts") -> DataFrame:
    """`df` with `out` in {-1.0, 0.0, 1.0}: long below -sigma rolling deviations of x, short above sigma.

    A position ends where x lies beyond the opposite threshold, or at the first usable row `hold` rows or more after its
    entry; the row of an exit is flat. Rows where x or its deviation is null, or the deviation 0, are not usable: they
    keep the position, and end a count of confirming rows. sigma, hold and confirm may be columns that are constant
    within a series, such as those of a grid whose keys are among `keys`.
    """
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    spread = rolled(F.col(x), lookback, "std", keys, order)
    work = df.withColumns({"_spread": spread, "_sigma": lit(sigma).cast("double"), "_hold": lit(hold).cast("double"), "_confirm": lit(confirm).cast("double")})
    step = crossing_step(x, "_spread", "_sigma", "_hold", out) if crossing else residency_step(x, "_spread", "_sigma", "_hold", "_confirm", out)
    return scanned(work, keys, order, step, {out: "double"}).drop("_spread", "_sigma", "_hold", "_confirm")


def entry_filter(df: DataFrame, signal: str, ok: str, out: str, keys: Sequence[str] = ("symbol",), order: str = "ts") -> DataFrame:
    """`signal`, but 0 from the first row of a run of non-zero values at which `ok` isn't true, to the run's end."""
    w = Window.partitionBy(*keys).orderBy(order)
    on = F.col(signal) != 0
    work = df.withColumn("_new", F.when(on & ~F.coalesce(F.lag(signal).over(w) != 0, F.lit(False)), 1).otherwise(0))
    work = work.withColumn("_run", F.sum("_new").over(until_now(keys, order)))
    blocked = F.max(on & ~F.coalesce(F.col(ok), F.lit(False))).over(until_now((*keys, "_run"), order))
    return work.withColumn(out, F.when(on & blocked, F.lit(0.0)).otherwise(F.col(signal))).drop("_new", "_run")


def regime_switch(vol: Column, reverting: Column, trending: Column, low: float, high: float) -> Column:
    """The reverting signal below `low`, the trending one (null as 0) from `high` on, 0 between and for null."""
    return F.when(vol < low, reverting).when(vol >= high, F.coalesce(trending, F.lit(0.0))).otherwise(F.lit(0.0))


def vol_floor(signal: Column, vol: Column, floor: float) -> Column:
    """0 where the percentile is below the floor or null."""
    return F.when(F.coalesce(vol < floor, F.lit(True)), F.lit(0.0)).otherwise(signal)


def regime_gate(signal: Column, regime: Column) -> Column:
    """0 unless the regime is 1."""
    return F.when(regime.eqNullSafe(F.lit(1.0)), signal).otherwise(F.lit(0.0))


def exhaustion_filter(signal: Column, deviation: Column, threshold: float = 1.5) -> Column:
    """Longs need a deviation below -threshold, shorts one above it; a null deviation stops nothing."""
    stop = ((signal == 1) & (deviation >= -threshold)) | ((signal == -1) & (deviation <= threshold))
    return F.when(F.coalesce(stop, F.lit(False)), F.lit(0.0)).otherwise(signal)
