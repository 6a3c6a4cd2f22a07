"""Irregular readings onto each source's regular grid (problem 4).

Grid slots and readings are merged in order of time, and each slot takes the reading before it and the one at or after
it: an as-of merge to both sides. The merge runs by source and stretch of time, so that a source of a third of all
readings spreads over many tasks; the last reading before a stretch and the first after it are put in as rows, found
by one small aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRETCH_S = 1 << 20
#: Slots made at once.
RUN = 4096


def slots(listings: DataFrame) -> DataFrame:
    """(provider, symbol, slot, step): every slot of each listing's grid, in microseconds since 1970 UTC.

    A slot every step_minutes from window_start on, before window_end; in trading_session `fx` only Monday to Friday
    and Sunday from 22:00 UTC, in any other all. A listing with a null bound, or a step that is null or below 1, has
    none. A listing given twice counts once.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    each = listings.select(
        "provider",
        "symbol",
        micros("window_start").alias("begins"),
        micros("window_end").alias("ends"),
        (F.col("step_minutes").cast("bigint") * 60_000_000).alias("step"),
        F.coalesce(F.col("trading_session") == "fx", F.lit(False)).alias("fx"),
    ).where("begins < ends and step > 0").distinct()
    n = F.ceil((F.col("ends") - F.col("begins")) / F.col("step"))
    runs = each.withColumn("n", n).withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / RUN))))  # no long arrays
    places = F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("n")) - 1)
    exploded = runs.withColumn("place", F.explode(places)).select("provider", "symbol", "step", "fx", (F.col("begins") + F.col("place") * F.col("step")).alias("slot"))
    minute = F.pmod(F.floor(F.col("slot") / 60_000_000) + 3 * 1440, F.lit(7 * 1440))  # of the week that begins on Monday; 1970 began on a Thursday
    in_session = ~F.col("fx") | (minute < 5 * 1440) | (minute >= 6 * 1440 + 22 * 60)
    return exploded.where(in_session).select("provider", "symbol", "slot", "step")


def on_grid(readings: DataFrame, listings: DataFrame, value: str, max_gap_minutes: int, stretch_s: int = STRETCH_S) -> DataFrame:
    """(provider, symbol, slot, missing, value): each slot of `slots`, slot in seconds since 1970 UTC.

    missing: no reading with a value has its ts in [slot, slot + step). value: that of a reading at the slot's very
    start, else linear in time between the last reading before the slot and the first after it, if they are at most
    max_gap_minutes apart, else null. Readings whose value is null or NaN, or whose ts is null, don't exist. Of several
    readings at one time the least value is the one at or after, and the greatest the one before. A reading without a
    listing is ignored but a listing without readings has all its slots missing. Empty tables give no slots. Other
    columns are ignored.
    """
    width = stretch_s * 1_000_000
    stretch = lambda c: F.floor(F.col(c) / width)
    real = F.col(f"`{value}`").cast("double")
    read = (
        readings.select("provider", "symbol", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), real.alias("v"))
        .where(F.col("at").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
        .withColumn("stretch", stretch("at"))
    )
    grid = slots(listings).withColumn("stretch", stretch("slot"))
    spans = listings.select(
        "provider",
        "symbol",
        F.floor(F.unix_micros(F.col("window_start").cast("timestamp")) / width).alias("a"),
        F.floor(F.unix_micros(F.col("window_end").cast("timestamp")) / width).alias("b"),
    ).where("a <= b")
    spans = spans.select("provider", "symbol", F.explode(F.sequence("a", "b")).alias("stretch"))
    reading = F.struct("at", "v")
    ends = (
        read.select("provider", "symbol", "stretch", reading.alias("r"), F.lit(False).alias("wanted"))
        .unionByName(spans.withColumns({"r": F.lit(None).cast("struct<at:bigint,v:double>"), "wanted": F.lit(True)}))
        .groupBy("provider", "symbol", "stretch")
        .agg(F.min("r").alias("first"), F.max("r").alias("last"), F.max("wanted").alias("wanted"))
    )
    by = "(partition by provider, symbol order by stretch)"
    carried = (
        ends.withColumns({
            "before": F.expr(f"lag(last, 1) ignore nulls over {by}"),
            "after": F.expr(f"lead(first, 1) ignore nulls over {by}"),
        })
        .where("wanted")
        .select("provider", "symbol", "stretch", F.explode(F.array_compact(F.array("before", "after"))).alias("r"))
        .select("provider", "symbol", "stretch", F.col("r.at").alias("at"), F.col("r.v").alias("v"))
    )
    none = F.lit(None)
    merged = (
        grid.select("provider", "symbol", "stretch", F.col("slot").alias("t"), "step", none.cast("bigint").alias("at"), none.cast("double").alias("v"))
        .unionByName(read.unionByName(carried).select("provider", "symbol", "stretch", F.col("at").alias("t"), none.cast("bigint").alias("step"), "at", "v"))
    )
    # A slot stands before the readings of its own time: nulls come first.
    over = "over (partition by provider, symbol, stretch order by t, at, v)"
    near = merged.withColumns({
        "at0": F.expr(f"last(at) ignore nulls {over}"),
        "v0": F.expr(f"last(v) ignore nulls {over}"),
        "at1": F.expr(f"lead(at, 1) ignore nulls {over}"),
        "v1": F.expr(f"lead(v, 1) ignore nulls {over}"),
    }).where("step is not null")
    gap = F.col("at1") - F.col("at0")
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * ((F.col("t") - F.col("at0")) / gap)
    return near.select(
        "provider",
        "symbol",
        F.floor(F.col("t") / 1_000_000).alias("slot"),
        (~F.coalesce(F.col("at1") < F.col("t") + F.col("step"), F.lit(False))).alias("missing"),
        F.when(F.col("at1") == F.col("t"), F.col("v1")).when(gap <= max_gap_minutes * 60_000_000, line).alias("value"),
    )
