"""Implausible measurements, judged by their own series (problem 5).

A series is cut into stretches of time; the rows near a cut are also given to the stretches within reach, so rolling
medians and runs are computed by (series, stretch) alone and equal those over the whole series. The series' median
change is selected exactly by counting: first by logarithmic bins, then by value within the bins that hold the middle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.tables import written

STRETCH_S = 1 << 21


def exact_medians(values: DataFrame, keys: Sequence[str], value: str, bins_per_e: int = 256) -> DataFrame:
    """(keys, median): the exact median of values >= 0 of each group; groups without values that aren't null are absent.

    Values are counted by (keys, logarithmic bin) and, in the bins that hold the middle ranks, by (keys, value): two
    map-side aggregates. No task holds a group's values; a group of a third of all rows costs its bins.
    """
    own = [F.col(k) for k in keys]
    rows = values.where(F.col(value).isNotNull()).withColumn(
        "_bin", F.when(F.col(value) > 0, F.floor(F.ln(value) * bins_per_e)).otherwise(F.lit(-(1 << 40)))
    )
    counts = rows.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_bin")
    ranked = counts.withColumns({
        "_below": F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_all": F.sum("_n").over(Window.partitionBy(*keys)),
    })
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    holds = lambda n: ((F.col("_below") < low) & (low <= F.col("_below") + n)) | ((F.col("_below") < high) & (high <= F.col("_below") + n))
    middle = ranked.where(holds(F.col("_n"))).select(*keys, "_bin", "_below", "_all")
    same = F.expr(" and ".join(f"r.`{k}` <=> m.`{k}`" for k in (*keys, "_bin")))
    inside = (
        rows.alias("r")
        .join(middle.alias("m"), same)
        .groupBy(*[F.col(f"m.{k}").alias(k) for k in keys], F.col(f"r.{value}").alias("_v"), "m._bin", "m._below", "m._all")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = inside.withColumn("_below", F.col("_below") + before)
    at = lambda rank: F.max(F.when((F.col("_below") < rank) & (rank <= F.col("_below") + F.col("_n")), F.col("_v")))
    return placed.groupBy(*own).agg(((at(low) + at(high)) / 2).alias("median"))


def _impossible() -> Column:
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    tests = [*(x <= 0 for x in (o, h, lo, c)), h < o, h < c, h < lo, lo > o, lo > c]
    out: Column = F.lit(False)
    for test in tests:
        out = out | F.coalesce(test, F.lit(False))
    return out


def judged(bars: DataFrame, window: int = 11, stuck_run: int = 8, stretch_s: int = STRETCH_S, spread: bool = False) -> DataFrame:
    """(bar_id, provider, symbol, impossible, stuck, far, change), one row for each bar of a series that counts; with
    spread also mad, the median absolute deviation of the window's closes from their median.

    Of bars with equal provider, symbol and ts the lowest bar_id counts (of equal ones the least by close, high, low and
    open, nulls first); then bars whose close is null or NaN, or whose
    ts is null, are left out. A series is a provider and symbol (null is a value) in the order of ts. far: the greatest
    distance of high, low or close from the median close of `window` bars centred on the bar, fewer at the ends.
    stuck: one of at least stuck_run successive bars with the same close. change: distance to the close before, null
    for a series' first bar. The result is written to the shared folder once, as it is read several times.
    """
    reach = max(window // 2, stuck_run - 1)
    clean = lambda c: F.when(~F.isnan(F.col(c)), F.col(c)).alias(c)
    rows = (
        bars.select("bar_id", "provider", "symbol", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), *map(clean, ("open", "high", "low", "close")))
        .where("t is not null")
        .withColumn("stretch", F.floor(F.col("t") / (stretch_s * 1_000_000)))
    )
    place = ("provider", "symbol", "stretch")
    first = Window.partitionBy(*place).orderBy("t", "bar_id", "close", "high", "low", "open")
    series = (
        rows.withColumn("_same", F.lag("t").over(first) == F.col("t"))
        .where("_same is null or not _same")
        .where("close is not null")
        .select("bar_id", *place, "t", _impossible().alias("impossible"), F.greatest("high", "low", "close").alias("top"), F.least("high", "low", "close").alias("bottom"), "close")
    )
    # The rows within reach of a cut, and the other stretches they are within reach of.
    w = Window.partitionBy(*place).orderBy("t")
    edge = series.withColumns({"_a": F.lag("t", reach).over(w), "_b": F.lead("t", reach).over(w)}).where("_a is null or _b is null").select(*place, "t", "close")
    along = Window.partitionBy("provider", "symbol").orderBy("t")
    near = F.array_distinct(F.array_compact(F.array(*[f("stretch", k).over(along) for k in range(1, reach + 1) for f in (F.lag, F.lead)])))
    halo = (
        edge.withColumn("_near", near)
        .select("provider", "symbol", F.col("stretch").alias("_own"), "t", "close", F.explode("_near").alias("stretch"))
        .where("stretch != _own")
        .drop("_own")
    )
    both = series.withColumn("own", F.lit(True)).unionByName(halo.withColumn("own", F.lit(False)), allowMissingColumns=True)
    half = window // 2
    around = F.array_sort(F.collect_list("close").over(w.rowsBetween(-half, half)))
    n = F.size("_around")
    middle = (F.element_at("_around", F.floor((n + 1) / 2).cast("int")) + F.element_at("_around", (F.floor(n / 2) + 1).cast("int"))) / 2
    before = F.lag("close").over(w)
    starts = F.when(before.isNull() | (before != F.col("close")), F.row_number().over(w))
    over = "over (partition by provider, symbol, stretch order by t)"
    seen = both.withColumns({"_around": around, "change": F.abs(F.col("close") - before), "_start": starts, "_row": F.row_number().over(w)})
    seen = seen.withColumns({
        "_begin": F.expr(f"last(_start) ignore nulls {over}"),
        "_next": F.expr(f"lead(_start, 1) ignore nulls {over}"),
        "_end": F.expr("count(1) over (partition by provider, symbol, stretch)"),
    })
    run = F.coalesce(F.col("_next"), F.col("_end") + 1) - F.col("_begin")
    far = F.greatest(F.abs(F.col("top") - middle), F.abs(F.col("bottom") - middle))
    out = seen.withColumn("_middle", middle) if spread else seen
    off = F.array_sort(F.transform("_around", lambda c: F.abs(c - F.col("_middle"))))
    mad = [((F.element_at(off, F.floor((n + 1) / 2).cast("int")) + F.element_at(off, (F.floor(n / 2) + 1).cast("int"))) / 2).alias("mad")] if spread else []
    out = out.where("own").select("bar_id", "provider", "symbol", "impossible", (run >= stuck_run).alias("stuck"), far.alias("far"), "change", *mad)
    return out if spread else written(out, "spikes")  # the median change reads the rows twice more


#: A median absolute deviation times this is the deviation of a normal variable.
NORMAL_MAD = 1.4826


def hampel(bars: DataFrame, window: int = 11, times: float = 3.0, stuck_run: int = 8, stretch_s: int = STRETCH_S) -> DataFrame:
    """As `implausible`, but a spike is further from the rolling median than `times` NORMAL_MAD of the window's own median
    absolute deviation (Hampel's filter). Where that is 0 nothing is a spike."""
    rows = judged(bars, window, stuck_run, stretch_s, spread=True)
    spike = (F.col("mad") > 0) & (F.col("far") > times * NORMAL_MAD * F.col("mad"))
    kind = F.when(F.col("impossible"), "impossible").when(spike, "spike").when(F.col("stuck"), "stuck")
    return rows.select("bar_id", kind.alias("kind")).where("kind is not null")


def implausible(bars: DataFrame, window: int = 11, times: float = 27.0, stuck_run: int = 8, stretch_s: int = STRETCH_S) -> DataFrame:
    """(bar_id, kind) of the bars that cannot be true; kind is the first that holds of `impossible` (a price at or below
    0, or a high or low that another price passes; nulls break no rule), `spike` (further from the rolling median
    than `times` the series' median change) and `stuck`. See `judged` for nulls, repeated bars and ties. A series of
    one bar has no median change and so no spike. An empty table gives no rows.
    """
    rows = judged(bars, window, stuck_run, stretch_s)
    medians = exact_medians(rows.select("provider", "symbol", "change"), ("provider", "symbol"), "change")
    medians = medians.select(F.col("provider").alias("_p"), F.col("symbol").alias("_s"), "median")
    kind = F.when(F.col("impossible"), "impossible").when(F.col("far") > times * F.col("median"), "spike").when(F.col("stuck"), "stuck")
    return (
        rows.join(medians, F.expr("provider <=> _p and symbol <=> _s"), "left")
        .select("bar_id", kind.alias("kind"))
        .where("kind is not null")
    )
