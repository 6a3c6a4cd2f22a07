from datetime import datetime, timedelta

from pyspark.sql import functions as F

from barloom.operators import machines
from barloom.plans import live as plans
from barloom.plans import research
from barloom.streaming import live

T = datetime(2024, 1, 1)


def test_stream_bars_equal_batch_bars(spark, sf):
    assert sorted(plans.stream_bars(spark, sf).collect(), key=str) == sorted(research.bars_hourly(spark, sf).collect(), key=str)


def test_signals_over_batches_equal_the_batch(spark, tmp_path):
    values = [0.0, 0.5, 0.0, -3.0, None, 0.0, 4.0, 0.1, -0.2, -5.0, 0.0, 0.3]
    rows = [(s, T + timedelta(hours=i), v) for s in "ab" for i, v in enumerate(values)]
    schema = "symbol string, ts timestamp, x double"
    for k in range(4):
        spark.createDataFrame([r for r in rows if k * 3 <= (r[1] - T).seconds // 3600 < k * 3 + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for crossing in (False, True):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = {(r.symbol, r.ts): r.signal for r in live.drained(live.live_signals(stream, "x", 1.0, 3, lookback=3, crossing=crossing), "append").collect()}
        batch = machines.threshold_signals(spark.createDataFrame(rows, schema), "x", "sig", 1.0, 3, lookback=3, crossing=crossing)
        assert got == {(r.symbol, r.ts): r.sig for r in batch.collect()}


def test_sessions_and_repeats(spark, tmp_path):
    rows = [(1, T, 1), (1, T + timedelta(minutes=5), 2), (1, T + timedelta(minutes=5), 2), (1, T + timedelta(hours=3), 3), (1, T + timedelta(days=3), 4)]
    spark.createDataFrame(rows, "u int, ts timestamp, id int").write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("u int, ts timestamp, id int").parquet(str(tmp_path / "in"))
    assert sorted(r.n for r in live.drained(live.session_counts(read(), F.col("u"), "ts")).collect()) == [1, 1, 3]
    assert live.drained(live.without_repeats(read(), ["id"], "ts", "10 days"), "append").count() == 4
