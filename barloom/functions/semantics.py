"""Rules of nulls, partial windows and small-sample statistics that every operator shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS, ORDER = ("symbol",), "ts"


def whole(keys: Sequence[str] = KEYS, order: str = ORDER) -> WindowSpec:
    """A series in its order."""
    return Window.partitionBy(*keys).orderBy(order)


def last_rows(n: int, keys: Sequence[str] = KEYS, order: str = ORDER) -> WindowSpec:
    """The n rows that end at the current one."""
    return whole(keys, order).rowsBetween(-(n - 1), 0)


def until_now(keys: Sequence[str] = KEYS, order: str = ORDER) -> WindowSpec:
    return whole(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def at_least(count: int, x: Column, w: WindowSpec, value: Column) -> Column:
    """`value` where the window holds at least `count` values of x that aren't null."""
    return F.when(F.count(x).over(w) >= count, value)


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """NaN becomes null in the named columns, so that aggregates skip it."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def rolled(x: Column, n: int, how: str, keys: Sequence[str] = KEYS, order: str = ORDER, least: int | None = None) -> Column:
    """A rolling mean, std (of a sample), sum, min, max or median over n rows, null with fewer than `least` values (n)."""
    w = last_rows(n, keys, order)
    f = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "min": F.min, "max": F.max, "median": F.median}[how]
    return at_least(n if least is None else least, x, w, f(x).over(w))


def average_rank(x: Column, by: Sequence[str]) -> Column:
    """Rank with ties at their mean, over rows grouped by `by`; give it rows whose x isn't null."""
    w = Window.partitionBy(*by).orderBy(x)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return F.rank().over(w) + (ties - 1) / 2


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness as an aggregate; null for fewer than 3 values."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis as an aggregate; null for fewer than 4 values."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))
