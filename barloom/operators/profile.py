"""Column profiles of loads, and the columns that break given limits (problem 1).

The rows of each load are unpivoted to (load, column, value), counted by value before anything else is computed, and
the counts are folded into frequencies, distinct values, ranges and histograms. The first shuffle is keyed by the
value, so that a load or column of a third of all rows spreads over all tasks; the later ones carry one row for each
(load, column, histogram bin).

The histograms of a profile are fixed ones. `distances` compares loads on the values themselves instead: counts by value
of texts, counts by the baseline's quantile bins of numbers and timestamps.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.sources.tables import written

#: The parts of a baseline whose ends, values of its own, bound the bins of a number.
TENTHS = 10
#: Whole numbers up to here, in size, are doubles of their own.
EXACT = 1 << 53


def _is_text(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.NumericType, T.BooleanType))


def _split(c: Column, kind: T.DataType) -> tuple[Column, Column]:
    """A value as (number, text), one of which is null."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double"), F.lit(None).cast("string")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        num = c.cast("double")
        return F.when(~F.isnan(num), num), F.lit(None).cast("string")
    return F.lit(None).cast("double"), c.cast("string")


def _told(c: Column, kind: T.DataType) -> Column:
    """The text that tells a value apart: a text itself; of numbers, decimals and whole ones beyond EXACT, else null."""
    none = F.lit(None).cast("string")
    if isinstance(kind, T.DecimalType):
        return c.cast("string")
    if isinstance(kind, T.LongType):
        return F.when((c > EXACT) | (c < -EXACT), c.cast("string"))
    return _split(c, kind)[1] if _is_text(kind) else none


def value_counts(df: DataFrame, load: str, columns: Sequence[str], places: Sequence[int] | None = None) -> DataFrame:
    """(load, column_no, num, txt, n): how often each value of each column occurs in each load; column_no is the place in
    `columns`, as names would be most of what is shuffled. places: those of the columns to count, all by default.

    Numbers and booleans go to num; all else to txt as a string, timestamps as microseconds in num. Decimals, and whole
    numbers that no double can hold, have their digits in txt too, so that different ones are counted apart. NaN counts
    as null. A null is a row with num and txt null. An empty table gives no row; columns of `df` that aren't named are
    not read, whatever their names.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = []
    for place in range(len(columns)) if places is None else places:
        name = columns[place]
        num, _ = _split(F.col(f"`{name}`"), kinds[name])
        cells.append(F.struct(F.lit(place).alias("column_no"), num.alias("num"), _told(F.col(f"`{name}`"), kinds[name]).alias("txt")))
    long = df.select(F.col(f"`{load}`").alias("load"), F.explode(F.array(*cells)).alias("cell"))
    return long.groupBy("load", "cell.column_no", "cell.num", "cell.txt").agg(F.count(F.lit(1)).alias("n"))


def _bin() -> Column:
    """A fixed bin of a value: sign and binary order of magnitude of numbers, length of texts; null for null."""
    num = F.col("num")
    size = F.floor(F.log2(F.abs(num))).cast("int")
    return (
        F.when(num == 0, F.lit(0))
        .when(num > 0, F.least(F.greatest(size, F.lit(-1000)), F.lit(1000)) + 2000)
        .when(num < 0, -(F.least(F.greatest(size, F.lit(-1000)), F.lit(1000)) + 2000))
        .otherwise(F.length("txt"))
    )


def profile(df: DataFrame, load: str, columns: Sequence[str], patterns: Mapping[str, str] | None = None) -> DataFrame:
    """One row for each load and column, over all rows of the load as delivered (repeats count).

    Columns: load, column_name, n_rows, n_nulls, n_zeros, n_negative, n_distinct (values that aren't null), min_num,
    max_num, mean_num, mean_positive (null without values above 0), min_txt, max_txt (of columns that aren't numbers or
    times), n_unmatched (values that aren't null and don't match the column's pattern; 0 without a pattern), bins (map
    from bin to rows, nulls left out). n_distinct is exact for whole numbers and decimals of any size; min_num, max_num
    and the means are doubles.
    Rows whose load is null form one load. An empty table gives an empty profile.
    """
    n, num, txt = F.col("n"), F.col("num"), F.col("txt")
    there = num.isNotNull() | txt.isNotNull()
    unmatched: Column = F.lit(False)
    for name, pattern in (patterns or {}).items():
        value = F.coalesce(txt, num.cast("string"))
        unmatched = unmatched | ((F.col("column_no") == list(columns).index(name)) & there & ~value.rlike(pattern))
    counted = lambda test: F.sum(F.when(test, n).otherwise(0))
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def part(places: list[int], *more: Column) -> DataFrame:
        return value_counts(df, load, columns, places).groupBy("load", "column_no", _bin().alias("bin")).agg(
            F.sum(n).alias("n_rows"),
            counted(~there).alias("n_nulls"),
            counted(num == 0).alias("n_zeros"),
            counted(num < 0).alias("n_negative"),
            counted(num > 0).alias("n_positive"),
            F.count(F.when(there, 1)).alias("n_distinct"),
            F.min(num).alias("min_num"),
            F.max(num).alias("max_num"),
            F.sum(num * n).alias("sum_num"),
            F.sum(F.when(num > 0, num * n)).alias("sum_positive"),
            counted(unmatched).alias("n_unmatched"),
            *more,
        )

    # Numbers on their own, without a least and greatest text, are folded by hash instead of by sort; each part reads
    # its own columns only.
    texts = [i for i, name in enumerate(columns) if _is_text(kinds[name])]
    numbers = [i for i in range(len(columns)) if i not in texts]
    none = F.lit(None).cast("string")
    parts = [part(numbers).withColumns({"min_txt": none, "max_txt": none})] if numbers else []
    parts += [part(texts, F.min(txt).alias("min_txt"), F.max(txt).alias("max_txt"))] if texts else []
    binned = reduce(DataFrame.unionByName, parts)
    total = [F.sum(c).alias(c) for c in ("n_rows", "n_nulls", "n_zeros", "n_negative", "n_distinct", "n_unmatched")]
    folded = binned.groupBy("load", "column_no").agg(
        *total,
        F.sum("n_positive").alias("n_positive"),
        F.min("min_num").alias("min_num"),
        F.max("max_num").alias("max_num"),
        F.sum("sum_num").alias("sum_num"),
        F.sum("sum_positive").alias("sum_positive"),
        F.min("min_txt").alias("min_txt"),
        F.max("max_txt").alias("max_txt"),
        F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n_rows")))).alias("bins"),
    )
    present = F.col("n_rows") - F.col("n_nulls")
    return folded.select(
        "load",
        F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("column_no") + 1).alias("column_name"),
        "n_rows",
        "n_nulls",
        "n_zeros",
        "n_negative",
        "n_distinct",
        "min_num",
        "max_num",
        F.try_divide(F.col("sum_num"), F.when(F.col("min_num").isNotNull(), present)).alias("mean_num"),
        F.try_divide(F.col("sum_positive"), F.col("n_positive")).alias("mean_positive"),
        "min_txt",
        "max_txt",
        "n_unmatched",
        "bins",
    )


def compared(profiles: DataFrame, baselines: DataFrame) -> DataFrame:
    """`profiles` beside those of each load's baseline load, by `baselines` (load, baseline).

    Adds base_distinct, base_mean_positive, psi (population stability index over the histogram bins, each share
    with half a row added) and chi2 (two-sample chi-square over the same bins). All four are null for a load without
    a baseline, or whose baseline has no rows. A load named twice in `baselines` takes its greatest baseline.
    """
    named = baselines.groupBy("load").agg(F.max("baseline").alias("baseline"))
    base = profiles.select(
        F.col("load").alias("baseline"),
        "column_name",
        F.col("n_distinct").alias("base_distinct"),
        F.col("mean_positive").alias("base_mean_positive"),
        F.col("bins").alias("base_bins"),
    )
    both = profiles.join(named, "load", "left").join(base, ["baseline", "column_name"], "left")
    keys = F.array_union(F.map_keys("bins"), F.map_keys("base_bins"))
    n = F.aggregate(F.map_values("bins"), F.lit(0).cast("bigint"), lambda s, x: s + x).cast("double")
    m = F.aggregate(F.map_values("base_bins"), F.lit(0).cast("bigint"), lambda s, x: s + x).cast("double")
    both = both.withColumns({"_keys": keys, "_n": n, "_m": m})
    at = lambda c, k: F.coalesce(F.try_element_at(F.col(c), k), F.lit(0)).cast("double")
    width = F.size("_keys")

    def psi(s: Column, k: Column) -> Column:
        p = (at("bins", k) + 0.5) / (F.col("_n") + width * 0.5)
        q = (at("base_bins", k) + 0.5) / (F.col("_m") + width * 0.5)
        return s + (p - q) * F.log(p / q)

    def chi2(s: Column, k: Column) -> Column:
        x, y = at("bins", k), at("base_bins", k)
        gap = x * F.sqrt(F.try_divide(F.col("_m"), F.col("_n"))) - y * F.sqrt(F.try_divide(F.col("_n"), F.col("_m")))
        return s + F.try_divide(gap * gap, x + y)

    return both.withColumns({
        "psi": F.when(width > 0, F.aggregate("_keys", F.lit(0.0), psi)),
        "chi2": F.when(width > 0, F.aggregate("_keys", F.lit(0.0), chi2)),
    }).drop("_keys", "_n", "_m", "base_bins")


def _order_bin(x: Column) -> Column:
    """A bin by sign and logarithm, so fine that seven hours of microseconds since 1970 are one; keeps the order."""
    size = lambda v: F.floor(F.log2(F.least(v, F.lit(1e308))) * 65536) + 1100 * 65536
    return F.when(x > 0, size(x)).when(x < 0, -size(-x)).otherwise(F.lit(0)).cast("bigint")


def _bounds(numbers: DataFrame) -> DataFrame:
    """(load, column_no, bound): bound.least, the least num, and bound.shared, those that several quantiles share, open a
    bin; bound.upto, the other quantiles, each end one. numbers: load, column_no, num. No task sorts a whole load."""
    by = ["load", "column_no"]
    rows = numbers.where("num is not null").withColumn("bin", _order_bin(F.col("num")))
    whole = Window.partitionBy(*by)
    ran = Window.unboundedPreceding, -1
    counted = rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumns({"below": F.coalesce(F.sum("n").over(whole.orderBy("bin").rowsBetween(*ran)), F.lit(0)), "all": F.sum("n").over(whole)})
    targets = counted.withColumn("at", F.transform(F.sequence(F.lit(0), F.lit(TENTHS)), lambda i: F.expr("(all - 1)") * i / TENTHS).cast("array<bigint>"))
    hit = lambda: F.filter("at", lambda t: (t >= F.col("below")) & (t < F.col("below") + F.col("n")))
    middle = targets.withColumn("at", hit()).where(F.size("at") > 0).select(*by, "bin", "at", F.col("below").alias("start"))
    values = rows.join(middle, [*by, "bin"]).groupBy(*by, "bin", "num", "at", "start").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "bin").orderBy("num").rowsBetween(*ran)), F.lit(0))
    found = values.withColumn("below", F.col("start") + before).withColumn("at", hit()).where(F.size("at") > 0)
    q = found.groupBy(*by).agg(F.sort_array(F.flatten(F.collect_list(F.array_repeat("num", F.size("at"))))).alias("q"))
    shared = F.array_distinct(F.filter("q", lambda e, i: (i > 0) & (e == F.get("q", i - 1))))
    return q.select(*by, F.struct(F.get("q", F.lit(0)).alias("least"), shared.alias("shared"), F.slice("q", 2, TENTHS).alias("upto")).alias("bound"))


def distances(df: DataFrame, load: str, columns: Sequence[str], baselines: DataFrame) -> DataFrame:
    """(load, baseline, column_name, n_values, base_values, n_cells, psi, chi2): how far each column of each load that
    has a baseline, by `baselines` (load, baseline), is from the baseline's.

    Texts are compared value by value over the values of both loads; numbers and timestamps by the bins that the
    baseline's least value, deciles and greatest value bound (exact, of its own values; what lies outside, and a value
    that several of them share, is a bin of its own). n_values and base_values count what isn't null, n_cells
    the values or bins that either load has. psi is the population stability index, each share with half a row added;
    chi2 the two-sample chi-square, null if either side has no value. A load named twice in `baselines` takes its
    greatest baseline; one without rows has no row here, and one whose baseline has no rows has nulls. A baseline's
    rows are read once for each load that names it. The quantiles, a row for each baseline, are written to the shared
    folder once.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    split = [_split(F.col(f"`{name}`"), kinds[name]) for name in columns]
    narrow = df.select(F.col(f"`{load}`").alias("load"), *[c.alias(f"{kind}{i}") for i, pair in enumerate(split) for kind, c in zip(("num", "txt"), pair)])
    named = baselines.groupBy("load").agg(F.max("baseline").alias("baseline")).where("load is not null and baseline is not null")

    numeric = [i for i, name in enumerate(columns) if not _is_text(kinds[name])]
    bases = named.select(F.col("baseline").alias("load")).distinct()
    nums = F.array(*[F.struct(F.lit(i).alias("column_no"), F.col(f"num{i}").alias("num")) for i in numeric]).cast("array<struct<column_no: int, num: double>>")
    ends = _bounds(narrow.join(bases, "load", "left_semi").select("load", F.inline(nums))).select("load", F.struct("column_no", "bound").alias("b"))
    bounds = written(ends.groupBy(F.col("load").alias("baseline")).agg(F.map_from_entries(F.collect_list("b")).alias("bounds")), "quantiles")
    in_order = F.array(*[F.try_element_at("bounds", F.lit(i)) for i in numeric]).alias("bounds")

    side = lambda name, x, y: F.struct(F.col(name).alias("load"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    sides = named.join(bounds, "baseline", "left").select(F.col("load").alias("target"), "baseline", in_order, F.inline(F.array(side("load", 1, 0), side("baseline", 0, 1))))

    def bin(v: Column, b: Column) -> Column:
        above = F.size(F.filter(b["upto"], lambda e: e < v)) + F.size(F.filter(b["shared"], lambda e: e <= v))
        return F.when(v.isNotNull(), F.coalesce(above + F.when(v >= b["least"], 1).otherwise(0), F.lit(0)))

    placed = narrow.join(sides, "load").withColumn("bins", F.zip_with(F.array(*[F.col(f"num{i}") for i in numeric]), "bounds", bin) if numeric else F.array().cast("array<int>"))
    cells = [F.struct(F.lit(i).alias("column_no"), (F.get("bins", F.lit(numeric.index(i))) if i in numeric else F.lit(None).cast("int")).alias("bin"), F.col(f"txt{i}").alias("txt")) for i in range(len(columns))]
    long = placed.select("target", "baseline", "x", "y", F.inline(F.array(*cells)))
    counts = long.groupBy("target", "baseline", "column_no", "bin", "txt").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))

    there = F.col("bin").isNotNull() | F.col("txt").isNotNull()
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    p, q = x + 0.5, y + 0.5
    over = lambda c: F.sum(F.when(there, c))
    sums = counts.groupBy("target", "baseline", "column_no").agg(
        F.sum("x").alias("rows"), F.sum("y").alias("base_rows"), F.coalesce(over(F.col("x")), F.lit(0)).alias("n"), F.coalesce(over(F.col("y")), F.lit(0)).alias("m"), F.count(F.when(there, 1)).alias("w"),
        over(p * F.log(p / q)).alias("p_log"), over(q * F.log(p / q)).alias("q_log"), over(x * x / (x + y)).alias("xx"), over(x * y / (x + y)).alias("xy"), over(y * y / (x + y)).alias("yy"),
    )
    # Both distances, multiplied out, are sums over the values; the totals come in afterwards.
    half = F.col("w") / 2
    psi = F.col("p_log") / (F.col("n") + half) - F.col("q_log") / (F.col("m") + half)
    chi2 = F.try_divide("m", "n") * F.col("xx") + F.try_divide("n", "m") * F.col("yy") - 2 * F.col("xy")
    known = lambda c: F.when(F.col("base_rows") > 0, c)
    return sums.where("rows > 0").select(
        F.col("target").alias("load"),
        "baseline",
        F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("column_no") + 1).alias("column_name"),
        F.col("n").alias("n_values"),
        known(F.col("m")).alias("base_values"),
        known(F.col("w")).alias("n_cells"),
        known(F.when(F.col("w") > 0, psi)).alias("psi"),
        known(F.when(F.col("w") > 0, chi2)).alias("chi2"),
    )


def issues(profiles: DataFrame, limits: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """(load, column_name, issue) where a limit's condition holds. limits: issue -> column -> condition on a row of
    `compared`; a condition that is null doesn't hold."""
    found: list[Column] = []
    for issue, by_column in limits.items():
        test: Column = F.lit(False)
        for name, condition in by_column.items():
            test = test | ((F.col("column_name") == name) & F.coalesce(condition, F.lit(False)))
        found.append(F.when(test, F.lit(issue)))
    return profiles.select("load", "column_name", F.explode(F.array_compact(F.array(*found))).alias("issue"))
