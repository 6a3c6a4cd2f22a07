"""Streaming queries over the test tables, run to their end; the SQL is that of the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.catalog import standard
from barloom.config import environment
from barloom.plans import research
from barloom.sources.tables import table
from barloom.streaming import live


def _events(spark: SparkSession, d: str) -> DataFrame:
    return live.event_stream(spark, d, "events", table(spark, d, "events").schema)


def stream_bars(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars of the event stream."""
    bars = live.live_bars(_events(spark, d), F.col("event_type"), "ts", F.col("value"), F.col("event_id"))
    return research.shown(live.drained(bars).withColumn("ts", F.col("ts").cast("timestamp_ntz")), "open", "high", "low", "close", "volume")


def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Bars of two hours, one each hour."""
    bars = live.live_bars(_events(spark, d), F.col("event_type"), "ts", F.col("value"), F.col("event_id"), "2 hours", slide="1 hour")
    return research.shown(live.drained(bars).withColumn("ts", F.col("ts").cast("timestamp_ntz")), "open", "high", "low", "close", "volume")


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of events of each user, closed by a day's gap, as far as the watermark has closed them."""
    return live.drained(live.session_counts(_events(spark, d), F.col("user_id"), "ts", "1 day"), "append")


def stream_signals(spark: SparkSession, d: str) -> DataFrame:
    """The crossing signal of raw event values, by type."""
    rows = _events(spark, d).select(F.col("event_type").alias("symbol"), "ts", "value")
    return live.drained(live.live_signals(rows, "value", 1.5, 10, lookback=50, crossing=True), "append")


def stream_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Each event once."""
    return live.drained(live.without_repeats(_events(spark, d), ["event_id"], "ts", "60 days"), "append").select("event_id", "event_type")


def feature_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The features that are known by name."""
    return standard().summary(spark).select("name", "category", "expected_stationary")


def environment_report(spark: SparkSession, d: str) -> DataFrame:
    """What runs here."""
    return environment(spark)


QUERIES = {f.__name__: f for f in (stream_bars, stream_sliding, stream_sessions, stream_signals, stream_distinct, feature_catalog, environment_report)}
SQL = {"stream_bars": research.SQL["bars_hourly"], "stream_distinct": "select distinct event_id, event_type from events"}
