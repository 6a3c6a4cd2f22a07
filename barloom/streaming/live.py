"""Bars, repeats and signals over a stream. The state machines take the very steps of the batch operators."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.machines import crossing_step, residency_step
from barloom.sources.tables import shared_folder


def event_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """The parquet files of one name in a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def live_bars(stream: DataFrame, symbol: Column, ts: str, value: Column, tie: Column, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Bars of windows of event time; values later than `late` behind the newest are dropped. With slide, windows overlap."""
    clean = F.when(~F.isnan(value.cast("double")), value.cast("double"))
    at = F.col(ts).cast("timestamp")
    rows = stream.select(symbol.alias("symbol"), at.alias("at"), clean.alias("v"), F.struct(at, tie).alias("o")).where("v is not null").withWatermark("at", late)
    window = F.window("at", width, slide) if slide else F.window("at", width)
    out = rows.groupBy("symbol", window.alias("w")).agg(F.min_by("v", "o").alias("open"), F.max("v").alias("high"), F.min("v").alias("low"), F.max_by("v", "o").alias("close"), F.count("v").cast("double").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def session_counts(stream: DataFrame, key: Column, ts: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(key, start, end, n) of runs of events no further apart than `gap`."""
    rows = stream.select(key.alias("key"), F.col(ts).cast("timestamp").alias("at")).withWatermark("at", late)
    out = rows.groupBy("key", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def without_repeats(stream: DataFrame, keys: list[str], ts: str, late: str = "2 hours") -> DataFrame:
    """The first row of each keys; repeats are known as long as the watermark keeps them."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def live_signals(stream: DataFrame, x: str, sigma: float, hold: int, confirm: int = 0, lookback: int = 6048, crossing: bool = False) -> DataFrame:
    """(symbol, ts, signal) for a stream of (symbol, ts, x) whose rows come in order of ts from batch to batch; rows at
    or before a symbol's last time are dropped. State: the last `lookback` values and the machine's own."""
    step = crossing_step(x, "spread", "sigma", "hold", "signal") if crossing else residency_step(x, "spread", "sigma", "hold", "confirm", "signal")

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        own = pickle.loads(state.get[0]) if state.exists else {"kept": np.zeros(0), "at": None, "machine": {}}
        rows = pd.concat(list(frames)).sort_values("ts")
        if own["at"] is not None:
            rows = rows[rows["ts"] > own["at"]]
        if len(rows):
            values = rows[x].to_numpy(float)
            spread = pd.Series(np.concatenate((own["kept"], values))).rolling(lookback).std().to_numpy()[len(own["kept"]) :]
            n = len(rows)
            block = {x: values, "spread": spread, "sigma": np.full(n, sigma), "hold": np.full(n, float(hold)), "confirm": np.full(n, float(confirm))}
            signal = step(block, own["machine"])["signal"]
            own["kept"] = np.concatenate((own["kept"], values))[-(lookback - 1) :]
            own["at"] = rows["ts"].iloc[-1]
            state.update((pickle.dumps(own),))
            yield pd.DataFrame({"symbol": key[0], "ts": rows["ts"].to_numpy(), "signal": signal})

    narrow = stream.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.col(x).cast("double").alias(x))
    return narrow.groupBy("symbol").applyInPandasWithState(advance, "symbol string, ts timestamp, signal double", "state binary", "append", "NoTimeout")


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns what it put out, as a table in the shared folder.

    complete: the last batch's whole result; append: all batches' rows.
    """
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/barloom-stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{root}/out")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
