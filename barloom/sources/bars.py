"""Bars from files and from facts, their gaps, and where results go."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.semantics import until_now

BAR = ("open", "high", "low", "close", "volume")
# The columns of the layout without a header.
BROKER_COLUMNS = ("date", "time", *BAR)
TIME_COLUMNS = ("datetime", "timestamp", "date")
IGNORED = ("dividends", "stock splits", "date", "time", "datetime", "timestamp")


class LoadError(Exception):
    """A source that isn't there."""


class ValidationError(Exception):
    """A source whose rows break a rule that makes them useless."""


def bars(df: DataFrame, symbol: Column, ts: Column, value: Column, tie: Sequence[Column], unit: str) -> DataFrame:
    """(symbol, ts, open, high, low, close, volume) of each `unit` (hour, day ...) that has a value; volume counts values.

    tie: what orders values of one time, so that open and close are defined. Values that are null or NaN are no values.
    """
    order = F.struct(ts, *tie)
    clean = F.when(~F.isnan(value.cast("double")), value.cast("double"))
    rows = df.select(symbol.cast("string").alias("symbol"), F.date_trunc(unit, ts).cast("timestamp_ntz").alias("ts"), clean.alias("v"), order.alias("o")).where("v is not null")
    return rows.groupBy("symbol", "ts").agg(
        F.min_by("v", "o").alias("open"), F.max("v").alias("high"), F.min("v").alias("low"), F.max_by("v", "o").alias("close"), F.count("v").cast("double").alias("volume")
    )


def resolved(path: str, roots: Sequence[str] = ()) -> str:
    """The first of path itself and path under each root that exists; FileNotFoundError else. Paths with a scheme stay."""
    if "://" in path:
        return path
    for p in (path, *(os.path.join(r, path) for r in roots)):
        if os.path.exists(p):
            return os.path.abspath(p)
    raise FileNotFoundError(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system its scheme names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def first_of(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Of rows with equal keys the one with the least `seq`: keep-first in file order."""
    w = Window.partitionBy(*keys).orderBy(seq)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def read_bars(spark: SparkSession, path: str, symbol: str, header: bool | None = None) -> DataFrame:
    """Bars of CSV text in either layout: headed by names with a time column, or `date,time,open,high,low,close,volume`
    without a header, told apart by the two points of a date in the first cell unless `header` says so.

    Names are compared trimmed and in lower case. Times are UTC; one that can't be read leaves a null ts, and all such
    rows but the first fall to the rule for repeats: of rows with equal ts the first in the file stays. The only action
    reads the first line.
    """
    text = spark.read.text(path)
    line = text.limit(1).collect()
    if not line:
        raise LoadError(f"{path} is empty")
    if header is None:
        header = line[0][0].split(",")[0].count(".") != 2
    names = [n.strip().lower() for n in line[0][0].lstrip("﻿").split(",")] if header else list(BROKER_COLUMNS)
    raw = spark.read.option("header", header).schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    raw = raw.withColumns({"_block": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()})
    if header:
        when = next((c for c in TIME_COLUMNS if c in names), None)
        if when is None:
            raise ValidationError(f"{path} has no time column")
        ts = F.col(f"`{when}`").try_cast("timestamp")
    else:
        ts = F.try_to_timestamp(F.concat_ws(" ", "date", "time"), F.lit("yyyy.MM.dd HH:mm"))
    numbers = [F.col(f"`{c}`").try_cast("double").alias(c) for c in names if c not in IGNORED]
    rows = raw.select(F.lit(symbol).alias("symbol"), ts.cast("timestamp_ntz").alias("ts"), *numbers, F.struct("_block", "_line").alias("seq"))
    return first_of(rows, ("symbol", "ts"), "seq").drop("seq")


def read_folder(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """All files of a folder in the layout without a header as one table, symbol being the file's name without its end."""
    raw = spark.read.option("pathGlobFilter", pattern).schema(", ".join(f"{n} string" for n in BROKER_COLUMNS)).csv(folder)
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "")
    ts = F.try_to_timestamp(F.concat_ws(" ", "date", "time"), F.lit("yyyy.MM.dd HH:mm")).cast("timestamp_ntz")
    rows = raw.select(name.alias("symbol"), ts.alias("ts"), *[F.col(c).try_cast("double").alias(c) for c in BAR], F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("seq"))
    return first_of(rows, ("symbol", "ts"), "seq").drop("seq")


def scan_folder(spark: SparkSession, folder: str, pattern: str = "*.csv", freq: str = "h") -> DataFrame:
    """One row for each file of a folder: file, size, n_lines, n_unread (lines without a readable time), error, and the
    columns of `quality_report` over its bars, null where there is none.

    error: `empty`, or `no line can be read` (another layout, or bytes that aren't text); a file that Spark can't read
    at all counts as the latter. One bad file leaves the others' reports as they are. An empty folder gives no row.
    """
    from barloom.operators.quality import quality_report

    where = spark._jvm.org.apache.hadoop.fs.Path(folder, pattern)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    names = [(f.getPath().getName(), f.getLen()) for f in found if f.isFile()]
    files = spark.createDataFrame(names, "file string, size long")
    lenient = spark.read.option("pathGlobFilter", pattern).option("ignoreCorruptFiles", True)
    raw = lenient.schema(", ".join(f"{n} string" for n in BROKER_COLUMNS)).csv(folder)
    ts = F.try_to_timestamp(F.concat_ws(" ", "date", "time"), F.lit("yyyy.MM.dd HH:mm")).cast("timestamp_ntz")
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    seq = F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    rows = raw.select(file.alias("file"), ts.alias("ts"), *[F.col(c).try_cast("double").alias(c) for c in BAR], seq.alias("seq"))
    lines = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("ts").isNull()).alias("n_unread"))
    bars_ = first_of(rows.where("ts is not null"), ("file", "ts"), "seq").drop("seq")
    reports = quality_report(bars_, freq, keys=("file",))
    error = F.when(F.col("size") == 0, "empty").when(F.col("n_bars").isNull(), "no line can be read")
    joined = files.join(lines, "file", "left").join(reports, "file", "left")
    return joined.select("file", "size", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_unread", F.lit(0)).alias("n_unread"), error.alias("error"), *[c for c in reports.columns if c != "file"])


def load(spark: SparkSession, folder: str, symbol: str, ending: str = ".csv", with_checks: bool = False):
    """Bars of one symbol of a folder, with_checks also the table of named checks. LoadError for a symbol without a file,
    ValidationError if a bar's high or low is passed by another of its prices."""
    from barloom.operators.quality import checks, ohlc_violations

    path = os.path.join(folder, symbol + ending)
    if not exists(spark, path):
        raise LoadError(f"no bars of {symbol} in {folder}")
    out = read_bars(spark, path, symbol)
    if out.agg(ohlc_violations().alias("n")).first()[0]:
        raise ValidationError(f"{symbol}: low or high passed by open or close")
    return (out, checks(out, "ts")) if with_checks else out


def fill_gaps(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars without a close take the close before as all four prices, and volume 0; other bars stay as they are."""
    close = F.last("close", ignorenulls=True).over(until_now(keys))
    gap = F.col("close").isNull()
    out = df.withColumn("_close", close)
    fill = {c: F.when(gap, F.col("_close")).otherwise(F.col(c)) for c in ("open", "high", "low", "close")}
    return out.withColumns({**fill, "volume": F.when(gap, F.lit(0.0)).otherwise(F.col("volume"))}).drop("_close")


def swap_rates(spark: SparkSession, symbol: str, folder: str | None = None) -> DataFrame:
    """(symbol, date, long_bps, short_bps): the rates of <folder>/<SYMBOL>_swaps.csv, else one row without a date from
    the constants; KeyError if neither has the symbol. Case of the symbol doesn't count."""
    symbol = symbol.upper()
    path = os.path.join(folder, f"{symbol}_swaps.csv") if folder else None
    if path and exists(spark, path):
        rows = spark.read.option("header", True).schema("date date, long_bps double, short_bps double").csv(path)
        return rows.select(F.lit(symbol).alias("symbol"), "date", "long_bps", "short_bps")
    if symbol not in SWAP_DEFAULTS:
        raise KeyError(symbol)
    long, short = SWAP_DEFAULTS[symbol]
    return spark.createDataFrame([(symbol, None, long, short)], "symbol string, date date, long_bps double, short_bps double")


# Daily rates in basis points for a long and a short position.
SWAP_DEFAULTS = {
    "USDJPY": (0.50, -1.20),
    "EURUSD": (-0.35, 0.15),
    "GBPUSD": (-0.20, 0.05),
    "AUDUSD": (0.10, -0.80),
    "USDCHF": (0.40, -1.10),
    "NZDUSD": (0.05, -0.75),
    "USDCAD": (0.30, -0.90),
    "EURGBP": (-0.15, 0.05),
    "EURJPY": (0.20, -1.00),
    "GBPJPY": (0.35, -1.30),
}


def through_cache(spark: SparkSession, path: str, df: DataFrame, keys: Sequence[str], make) -> DataFrame:
    """`df` left-joined with the table kept at `path`; `make(df)` writes it first where there is none."""
    if not exists(spark, path):
        make(df).write.parquet(path)
    return df.join(spark.read.parquet(path), list(keys), "left")


def write_results(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Results as parquet, csv (with a header) or json (a row a line)."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer = writer.option("header", True)
    elif kind not in ("parquet", "json"):
        raise ValueError(f"unknown kind {kind!r}")
    writer.format(kind).save(path)
