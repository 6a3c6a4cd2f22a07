"""Quality of bars: counts, outliers, missing bars, score, and named checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.semantics import whole

PRICES = ("open", "high", "low", "close")
_STEPS = {"h": "interval 1 hour", "d": "interval 1 day"}


def ohlc_violations() -> Column:
    """Aggregate: bars whose high is below another price, plus bars whose low is above one; a bar can count twice."""
    high = (F.col("high") < F.col("open")) | (F.col("high") < F.col("close")) | (F.col("high") < F.col("low"))
    low = (F.col("low") > F.col("open")) | (F.col("low") > F.col("close")) | (F.col("low") > F.col("high"))
    return F.count_if(high) + F.count_if(low)


def expected_slots(df: DataFrame, freq: str = "h", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """(keys, ts): the regular times between each series' first and last bar; hourly ones only from Monday to Friday and
    on Sunday from 22:00. Any other freq is daily and has no such mask. A series of one bar has none."""
    step = F.expr(_STEPS.get(freq.lower(), _STEPS["d"]))
    span = df.groupBy(*keys).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).where("a < b")
    out = span.select(*keys, F.explode(F.sequence("a", "b", step)).alias("ts"))
    if freq.lower() == "h":
        out = out.where((F.weekday("ts") <= 4) | ((F.weekday("ts") == 6) & (F.hour("ts") >= 22)))
    return out


def missing_bars(df: DataFrame, freq: str = "h", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """(keys, ts): expected times without a bar."""
    return expected_slots(df, freq, keys).join(df.select(*keys, "ts"), [*keys, "ts"], "left_anti")


def score() -> Column:
    """0 to 100 from ohlc_violations, negative_spreads, missing_pct, outliers and zero_volume_bars of a row."""
    off = lambda weight, c, most: F.least(F.col(c) * F.lit(weight), F.lit(float(most)))
    lost = off(5.0, "ohlc_violations", 30) + off(10.0, "negative_spreads", 30) + off(0.5, "missing_pct", 20) + off(0.1, "outliers", 10) + off(0.05, "zero_volume_bars", 10)
    return F.bround(F.greatest(F.lit(0.0), F.lit(100.0) - lost), 2)


def grade(c: str = "quality_score") -> Column:
    """The band of a score."""
    s = F.col(c)
    return F.when(s >= 95, "excellent").when(s >= 85, "good").when(s >= 70, "acceptable").when(s >= 50, "poor").otherwise("unusable")


def quality_report(df: DataFrame, freq: str = "h", sigmas: float = 5.0, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One row for each series: counts of violations, statistics of close and its returns, score, grade and warnings.

    Outliers are simple returns further than `sigmas` sample deviations from the series' mean return. A table without
    one of the price columns gives one row with score 0 and a warning; an empty one gives no row.
    """
    lacking = [c for c in (*PRICES, "volume") if c not in df.columns]
    if lacking:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bars")).select(*keys, "n_bars", F.lit(0.0).alias("quality_score"), F.array(F.lit("missing columns: " + ", ".join(lacking))).alias("warnings"))
    returns = df.withColumn("_r", F.try_divide(F.col("close"), F.lag("close").over(whole(keys))) - 1)
    spread = returns.groupBy(*keys).agg(F.avg("_r").alias("_mean"), F.stddev_samp("_r").alias("_std"))
    # Bars and due slots side by side: a slot without a bar is missing. One grouping, no join of the two.
    own = df.select(*keys, "ts", F.lit(1).alias("_bar"), F.lit(0).alias("_due"))
    slots = own.unionByName(expected_slots(df, freq, keys).select(*keys, "ts", F.lit(0).alias("_bar"), F.lit(1).alias("_due")))
    each = slots.groupBy(*keys, "ts").agg(F.max("_bar").alias("_bar"), F.max("_due").alias("_due"))
    due = each.groupBy(*keys).agg(F.count_if((F.col("_due") == 1) & (F.col("_bar") == 0)).alias("missing_bars"), F.sum("_due").alias("expected_bars"))
    counts = (
        returns.join(spread, list(keys))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_bars"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            ohlc_violations().alias("ohlc_violations"),
            F.count_if(F.col("high") < F.col("low")).alias("negative_spreads"),
            F.count_if(F.col("volume") == 0).alias("zero_volume_bars"),
            F.count_if(F.abs(F.col("_r") - F.col("_mean")) > sigmas * F.col("_std")).alias("outliers"),
            F.avg("close").alias("mean_close"),
            F.stddev_samp("close").alias("std_close"),
            F.min("low").alias("min_low"),
            F.max("high").alias("max_high"),
            F.avg("_r").alias("mean_return"),
            F.stddev_samp("_r").alias("std_return"),
        )
    )
    all_ = counts.join(due, list(keys), "left").na.fill(0, ["missing_bars", "expected_bars"])
    all_ = all_.withColumn("missing_pct", F.coalesce(F.try_divide(F.col("missing_bars") * 100.0, F.col("expected_bars")), F.lit(0.0)))
    all_ = all_.withColumn("quality_score", score()).withColumn("grade", grade())
    warn = lambda test, text: F.when(test, F.lit(text))
    return all_.withColumn(
        "warnings",
        F.array_compact(
            F.array(
                warn(F.col("ohlc_violations") > 0, "prices outside high and low"),
                warn(F.col("negative_spreads") > 0, "high below low"),
                warn(F.col("zero_volume_bars") > 0.01 * F.col("n_bars"), "more than 1 % of bars without volume"),
                warn(F.col("outliers") > 0, "returns beyond the limit"),
                warn(F.col("missing_bars") > 0, "missing bars"),
            )
        ),
    )


def checks(df: DataFrame, seq: str, spike_sigmas: float = 10.0, key: str = "symbol") -> DataFrame:
    """(symbol, check_name, is_valid, n_details) of the type of ts (a timestamp, which is UTC), duplicates, order (by `seq`), ohlc integrity, missing bars (whole
    weekends left out) and extreme spikes (which never make a series invalid)."""
    w = Window.partitionBy(key).orderBy(seq)
    steps = df.withColumns({"_back": F.lag("ts").over(w) > F.col("ts"), "_r": F.try_divide(F.col("close"), F.lag("close").over(whole((key,)))) - 1})
    spread = steps.groupBy(key).agg(F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_s"))
    one = steps.join(spread, key).groupBy(key).agg(
        (F.count(F.lit(1)) - F.count_distinct("ts")).alias("duplicates"),
        F.count_if("_back").alias("monotonic"),
        ohlc_violations().alias("ohlc_integrity"),
        F.count_if(F.abs(F.col("_r") - F.col("_m")) > spike_sigmas * F.col("_s")).alias("extreme_spikes"),
    )
    gaps = missing_bars(df, "h", (key,)).where(F.weekday("ts") < 5).groupBy(key).agg(F.count(F.lit(1)).alias("missing_bars"))
    no_time = int(not dict(df.dtypes)["ts"].startswith("timestamp"))
    all_ = one.join(gaps, key, "left").na.fill(0, ["missing_bars"]).withColumn("timezone", F.lit(no_time).cast("bigint"))
    names = ("timezone", "duplicates", "monotonic", "ohlc_integrity", "missing_bars", "extreme_spikes")
    long = all_.unpivot([key], list(names), "check_name", "n_details")
    return long.select(key, "check_name", ((F.col("n_details") == 0) | (F.col("check_name") == "extreme_spikes")).alias("is_valid"), "n_details")
