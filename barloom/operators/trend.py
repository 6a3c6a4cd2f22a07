"""Hodrick-Prescott trends: the one-sided trend as a fixed filter, and the two-sided one as a banded solve."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal, localcontext
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.scan import scanned, stretched


def _factor(n: int, lam) -> tuple[list, list, list]:
    """LDL' of I + lam K'K, K the second differences of n values: diagonal, first and second lower bands."""
    zero, one = lam * 0, lam * 0 + 1
    full = [[zero] * 3 for _ in range(n)]  # diagonal and the two bands above
    for i in range(n - 2):
        for a, x in enumerate((1, -2, 1)):
            for b, y in list(enumerate((1, -2, 1)))[a:]:
                full[i + a][b - a] += lam * (x * y)
    d, e, f = [zero] * n, [zero] * n, [zero] * n
    for i in range(n):
        d[i] = full[i][0] + one - (e[i - 1] ** 2 * d[i - 1] if i > 0 else zero) - (f[i - 2] ** 2 * d[i - 2] if i > 1 else zero)
        if i + 1 < n:
            e[i] = (full[i][1] - (e[i - 1] * f[i - 1] * d[i - 1] if i > 0 else zero)) / d[i]
        if i + 2 < n:
            f[i] = full[i][2] / d[i]
    return d, e, f


@cache
def endpoint_weights(lam: float, window: int) -> tuple[float, ...]:
    """Weights of the window's values in the trend at its end: the last row of (I + lam K'K)^-1, in 60 digits.

    In double precision the system is too ill-conditioned for large lam. The weights sum to 1 and keep straight lines.
    """
    if window < 10:
        raise ValueError("the window must have 10 rows at least")
    with localcontext() as context:
        context.prec = 60
        d, e, f = _factor(window, Decimal(lam))
        x = [Decimal(0)] * window  # L'x = D^-1 L^-1 u, and L^-1 u = u for the last unit vector
        for i in reversed(range(window)):
            x[i] = (1 / d[i] if i == window - 1 else Decimal(0)) - (e[i] * x[i + 1] if i + 1 < window else 0) - (f[i] * x[i + 2] if i + 2 < window else 0)
        return tuple(float(v) for v in x)


def causal_trends(df: DataFrame, price: str, lambdas: dict[str, float], window: int, keys: Sequence[str] = ("symbol",), order: str = "ts", stretch_rows: int | None = None) -> DataFrame:
    """`df` with, for each out -> lambda, the last trend value of the window of rows that ends at each row.

    Null prices take the price before. A row whose window reaches beyond the series' first price has a null trend.
    The product is taken of differences from the window's last price, which is exact as the weights sum to 1. With
    stretch_rows, series are cut into stretches of that many rows that run in parallel.
    """
    weights = {out: np.array(endpoint_weights(lam, window)) for out, lam in lambdas.items()}

    def step(block: dict[str, np.ndarray], state: dict) -> dict[str, np.ndarray]:
        values = block[price]
        kept = state.get("kept", np.zeros(0))
        x = np.concatenate((kept, values))
        seen = np.maximum.accumulate(np.where(~np.isnan(x), np.arange(len(x)), -1))
        if "kept" not in state:
            state["seed"] = block["_seed"][0] if "_seed" in block and len(values) else np.nan
        x = np.where(seen >= 0, x[np.maximum(seen, 0)], state["seed"])
        out = {name: np.full(len(values), np.nan) for name in weights}
        if len(x) >= window:
            view = np.lib.stride_tricks.sliding_window_view(x, window)
            first = max(0, len(kept) - window + 1)
            for at in range(first, len(view), 4096):
                part = view[at : at + 4096]
                last = part[:, -1]
                apart = part - last[:, None]
                place = at + window - 1 - len(kept)
                for name, w in weights.items():
                    out[name][place : place + len(part)] = last + apart @ w
        state["kept"] = x[-(window - 1) :]
        return out

    if stretch_rows is None:
        return scanned(df, keys, order, step, {n: "double" for n in lambdas})
    cut = stretched(df, keys, order, stretch_rows, window - 1, price)
    done = scanned(cut, (*keys, "_stretch"), order, step, {n: "double" for n in lambdas})
    return done.where("_own").drop("_stretch", "_own", "_seed")


def two_sided_trend(df: DataFrame, price: str, lam: float = 14400.0, keys: Sequence[str] = ("symbol",), order: str = "ts") -> DataFrame:
    """`df` with trend and cycle of each whole series, for looking at only: every value depends on all, also later, prices.

    One solve needs a whole series in a worker (a few dozen bytes a row); null prices are an error of the caller and
    make the series' trend null.
    """
    import pandas as pd

    names = [f.name for f in df.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", trend double, cycle double"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        y = pdf[price].to_numpy(float)
        if len(y) < 3 or np.isnan(y).any():
            trend = np.full(len(y), np.nan) if np.isnan(y).any() else y
        else:
            d, e, f = _factor(len(y), float(lam))
            z = y.tolist()
            for i in range(len(z)):
                z[i] -= (e[i - 1] * z[i - 1] if i > 0 else 0) + (f[i - 2] * z[i - 2] if i > 1 else 0)
            z = [v / p for v, p in zip(z, d)]
            for i in reversed(range(len(z))):
                z[i] -= (e[i] * z[i + 1] if i + 1 < len(z) else 0) + (f[i] * z[i + 2] if i + 2 < len(z) else 0)
            trend = np.array(z)
        return pdf[names].assign(trend=trend, cycle=y - trend)

    return df.groupBy(*keys).applyInPandas(solve, schema)
