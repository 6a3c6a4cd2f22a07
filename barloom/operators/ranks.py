"""Exact ranks and quantiles of large groups, without a task that holds or sorts a whole group.

Values are binned by sign and logarithm, which keeps their order. Counts by bin give what lies below each bin; only
within a bin are values, each of them once, sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bin(x: Column, per_e: int) -> Column:
    size = lambda v: F.floor(F.ln(v) * per_e) + 1000 * per_e
    return F.when(x > 0, size(x)).when(x < 0, -size(-x)).otherwise(F.lit(0)).cast("bigint")


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    return F.expr(" and ".join(f"{left}.`{c}` <=> {right}.`{c}`" for c in columns))


def average_ranks(df: DataFrame, by: Sequence[str], columns: dict[str, str], per_e: int = 4096) -> DataFrame:
    """`df` with, for each out -> column, the rank within `by` from 1, ties at their mean. Null has no rank.

    Rows are counted by value before anything is placed, so a value of a third of all rows is one row; values are then
    ranked within bins, what lies below a bin comes from the counts by bin, and the ranks are joined to the rows. Of
    that join the side of the values has one row a value, so a hot value's rows can be split. `df` is read once more
    for each column: write it first if it costs much.
    """
    out = df
    for name, x in columns.items():
        values = df.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        binned = values.withColumn("_bin", _bin(F.col("_v"), per_e))
        w = Window.partitionBy(*by, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        inside = binned.withColumn("_upto", F.sum("_n").over(w))
        counts = binned.groupBy(*by, "_bin").agg(F.sum("_n").alias("_c"))
        before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        below = counts.withColumn("_below", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
        placed = inside.alias("l").join(below.alias("r"), _same("l", "r", [*by, "_bin"]))
        ranks = placed.select(*[F.col(f"l.{k}").alias(k) for k in by], "_v", (F.col("_below") + F.col("_upto") - (F.col("_n") - 1) / 2).alias("_rank"))
        joined = out.alias("l").join(ranks.alias("r"), F.expr(" and ".join([*(f"l.`{k}` <=> r.`{k}`" for k in by), f"l.`{x}` = r._v"])), "left")
        out = joined.select(*[F.col(f"l.{c}") for c in out.columns if c != name], F.col("r._rank").alias(name))
    return out


def quantiles(df: DataFrame, by: Sequence[str], x: str, points: Sequence[float], per_e: int = 256) -> DataFrame:
    """(by, n, quantiles): the exact quantiles of the values that aren't null, linearly interpolated, in the order of
    `points`; groups without values are absent."""
    rows = df.where(F.col(x).isNotNull()).select(*by, F.col(x).alias("_v"), _bin(F.col(x), per_e).alias("_bin"))
    counts = rows.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by)
    ranked = counts.withColumns({
        "_below": F.coalesce(F.sum("_n").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_all": F.sum("_n").over(w),
    })
    at = [F.lit(float(p)) * (F.col("_all") - 1) for p in points]
    targets = [f(a) for a in at for f in (F.floor, F.ceil)]  # from 0
    inside = lambda n, t: (F.col("_below") <= t) & (t < F.col("_below") + n)
    wanted: Column = F.lit(False)
    for t in targets:
        wanted = wanted | inside(F.col("_n"), t)
    middle = ranked.where(wanted).select(*by, "_bin", "_below", "_all")
    found = (
        rows.alias("r")
        .join(middle.alias("m"), _same("r", "m", [*by, "_bin"]))
        .groupBy(*[F.col(f"m.{k}").alias(k) for k in by], F.col("r._v").alias("_v"), "m._bin", "m._below", "m._all")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = found.withColumn("_below", F.col("_below") + before)
    value = lambda t: F.max(F.when(inside(F.col("_n"), t), F.col("_v")))
    both = [(value(targets[2 * i]), value(targets[2 * i + 1]), F.max(a - targets[2 * i])) for i, a in enumerate(at)]
    return placed.groupBy(*by).agg(F.max("_all").alias("n"), F.array(*[lo + (hi - lo) * part for lo, hi, part in both]).alias("quantiles"))
