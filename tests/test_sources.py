import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from barloom import config
from barloom.catalog import FeatureSpec, standard
from barloom.operators import quality
from barloom.operators.series import Series
from barloom.sources import bars as src
from barloom.sources import tables


def write(path, text):
    path.write_text(text)
    return str(path)


BROKER = "2025.01.06,00:00,100,101,99,100.5,1000\n2025.01.06,00:00,1,1,1,1,1\nbad,00:00,1,1,1,1,1\n2025.01.05,23:00,99,100,98,99.5,x\n"


def test_both_layouts(spark, tmp_path):
    rows = src.read_bars(spark, write(tmp_path / "a.csv", BROKER), "A").orderBy("ts").collect()
    assert [(r.ts, r.open, r.volume) for r in rows] == [(None, 1.0, 1.0), (datetime(2025, 1, 5, 23), 99.0, None), (datetime(2025, 1, 6), 100.0, 1000.0)]
    headed = " Datetime ,Open,HIGH,Low,Close,Volume,Dividends,Stock Splits\n2025-01-06 00:00:00+02:00,1,2,0.5,1.5,7,0,0\n"
    r = src.read_bars(spark, write(tmp_path / "b.csv", headed), "B").first()
    assert (r.ts, r.high, r.volume) == (datetime(2025, 1, 5, 22), 2.0, 7.0) and "dividends" not in r.asDict()
    with pytest.raises(src.LoadError):
        src.read_bars(spark, write(tmp_path / "c.csv", ""), "C")
    with pytest.raises(src.ValidationError):
        src.read_bars(spark, write(tmp_path / "d.csv", "open,close\n1,2\n"), "D")


def test_folder_and_loader(spark, tmp_path):
    write(tmp_path / "X.csv", BROKER)
    write(tmp_path / "Y.csv", "2025.01.06,00:00,100,99,101,100,1000\n")
    counts = {r.symbol: r["count"] for r in src.read_folder(spark, str(tmp_path)).groupBy("symbol").count().collect()}
    assert counts == {"X": 3, "Y": 1}
    assert src.load(spark, str(tmp_path), "X").count() == 3
    bars, checks = src.load(spark, str(tmp_path), "X", with_checks=True)
    assert bars.count() == 3 and checks.count() == 6
    with pytest.raises(src.LoadError):
        src.load(spark, str(tmp_path), "Z")
    with pytest.raises(src.ValidationError):
        src.load(spark, str(tmp_path), "Y")
    assert src.resolved("X.csv", [str(tmp_path)]) == str(tmp_path / "X.csv") and src.resolved("s3://b/x") == "s3://b/x"
    with pytest.raises(FileNotFoundError):
        src.resolved("nothing.csv", [str(tmp_path)])


def test_scan_of_a_folder_reports_each_file(spark, tmp_path):
    write(tmp_path / "X.csv", BROKER)
    write(tmp_path / "Y.csv", "2025.01.06,00:00,100,99,101,100,1000\n")
    write(tmp_path / "empty.csv", "")
    write(tmp_path / "other.csv", "open,close\n1,2\n")
    (tmp_path / "bytes.csv").write_bytes(bytes(range(128, 256)) * 50)
    write(tmp_path / "left.txt", "no")
    got = {r.file: r for r in src.scan_folder(spark, str(tmp_path)).collect()}
    assert {f: r.error for f, r in got.items()} == {"X.csv": None, "Y.csv": None, "empty.csv": "empty", "other.csv": "no line can be read", "bytes.csv": "no line can be read"}
    assert (got["X.csv"].n_lines, got["X.csv"].n_unread, got["X.csv"].n_bars) == (4, 1, 2) and got["Y.csv"].ohlc_violations == 2
    assert got["empty.csv"].quality_score is None and src.scan_folder(spark, str(tmp_path), "*.none").count() == 0


def test_swap_rates(spark, tmp_path):
    assert src.swap_rates(spark, "usdjpy").first()[2:] == (0.5, -1.2)
    write(tmp_path / "EURUSD_swaps.csv", "date,long_bps,short_bps\n2024-01-01,1.0,2.0\n")
    assert src.swap_rates(spark, "eurusd", str(tmp_path)).first() == ("EURUSD", date(2024, 1, 1), 1.0, 2.0)
    with pytest.raises(KeyError):
        src.swap_rates(spark, "xxxyyy")


def test_sinks_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for kind in ("parquet", "csv", "json"):
        src.write_results(df, str(tmp_path / kind), kind)
        reader = spark.read.option("header", True) if kind == "csv" else spark.read
        assert reader.format(kind).load(str(tmp_path / kind)).count() == 2
    with pytest.raises(ValueError):
        src.write_results(df, str(tmp_path / "x"), "xml")
    made = []

    def make(d):
        made.append(1)
        return d.select("k", (F.col("k") * 2).alias("t"))

    for _ in range(2):
        assert {r.t for r in src.through_cache(spark, str(tmp_path / "cache"), df, ["k"], make).collect()} == {2, 4}
    assert made == [1]


def test_bars_and_gap_filling(spark):
    rows = [("s", datetime(2024, 1, 1, 0, 30), 2.0, 2), ("s", datetime(2024, 1, 1, 0, 30), 1.0, 1), ("s", datetime(2024, 1, 1, 0, 40), float("nan"), 3), ("s", datetime(2024, 1, 1, 2, 1), None, 4)]
    df = spark.createDataFrame(rows, "s string, t timestamp_ntz, v double, i int")
    assert [tuple(r)[1:] for r in src.bars(df, F.col("s"), F.col("t"), F.col("v"), [F.col("i")], "hour").collect()] == [(datetime(2024, 1, 1), 1.0, 2.0, 1.0, 2.0, 2.0)]
    gap = spark.createDataFrame([("s", 1, 100.0, 101.0, 99.0, 100.5, 5.0), ("s", 2, None, None, None, None, None), ("s", 3, 1.0, 1.0, 1.0, 1.0, 1.0)], "symbol string, ts int, open double, high double, low double, close double, volume double")
    assert tuple(src.fill_gaps(gap).orderBy("ts").collect()[1])[2:] == (100.5, 100.5, 100.5, 100.5, 0.0)
    assert src.first_of(df, ["t"], "i").count() == 3


def hours(spark, times, **prices):
    p = {"open": 100.0, "high": 101.0, "low": 99.0, "close": 100.0, "volume": 10.0} | prices
    return spark.createDataFrame([("s", t, *p.values()) for t in times], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def test_quality(spark):
    good = hours(spark, [datetime(2024, 1, 1, h) for h in range(24)])
    r = quality.quality_report(good).first()
    assert r.quality_score == 100.0 and r.grade == "excellent" and r.missing_bars == 0 and r.warnings == []
    bad = quality.quality_report(hours(spark, [datetime(2024, 1, 1, h) for h in range(10)], high=98.0, volume=0.0)).first()
    assert bad.ohlc_violations == 20 and bad.negative_spreads == 10 and bad.zero_volume_bars == 10 and bad.quality_score == 39.5
    assert quality.quality_report(good.limit(0)).count() == 0
    assert quality.quality_report(good.drop("close")).first().quality_score == 0
    weekend = hours(spark, [datetime(2024, 1, 5, 20), datetime(2024, 1, 8, 1)])
    missing = [x.ts for x in quality.missing_bars(weekend).orderBy("ts").collect()]
    assert missing == [datetime(2024, 1, 5, h) for h in (21, 22, 23)] + [datetime(2024, 1, 7, 22), datetime(2024, 1, 7, 23), datetime(2024, 1, 8, 0)]
    assert quality.missing_bars(good.limit(1)).count() == 0


def test_checks(spark):
    df = hours(spark, [datetime(2025, 1, 6, 1), datetime(2025, 1, 6, 0), datetime(2025, 1, 6, 0), datetime(2025, 1, 6, 4)], low=103.0).withColumn("seq", F.monotonically_increasing_id())
    got = {r.check_name: (r.is_valid, r.n_details) for r in quality.checks(df, "seq").collect()}
    assert got["timezone"] == (True, 0) and got["duplicates"] == (False, 1) and got["monotonic"] == (False, 1) and got["ohlc_integrity"][0] is False and got["missing_bars"] == (False, 2) and got["extreme_spikes"][0] is True


def test_written_table_goes_to_the_shared_folder(spark):
    df = tables.written(spark.range(3).withColumn("x", F.lit(None).cast("double")), "test")
    assert df.count() == 3 and "barloom-test-" in df.inputFiles()[0]
    assert "Range" not in df._jdf.queryExecution().executedPlan().toString()


def test_catalogue_and_configuration(spark, tmp_path):
    c = standard()
    assert len(c) == 11 and len(c.pending()) == 11 and len(c.by_category("Trend")) == 7
    with pytest.raises(ValueError):
        c.register(c.get("vol_regime"))
    with pytest.raises(KeyError):
        c.get("nothing")
    with pytest.raises(ValueError):
        FeatureSpec("x", "Other", lambda s, out: s, {})
    c.update_outcome("vol_regime", "Predictive", "seen")
    assert c.get("vol_regime").outcome == "Predictive" and c.summary(spark).where("outcome = 'Predictive'").first().notes == "seen"
    s = Series(hours(spark, [datetime(2024, 1, 1, h) for h in range(4)]).withColumn("trend", F.col("close")))
    assert "x" in c.get("hp_trend_slope").make(s, "x").df.columns
    path = write(tmp_path / "c.yaml", "execution:\n  slippage_bps: 0.2\n")
    assert config.setting(config.read_config(path), "execution.slippage_bps") == 0.2 and config.setting({}, "a.b", 7) == 7
    assert config.environment(spark).first().pyspark
    assert os.path.exists(path)


def test_scratch_tables_go_with_their_scratch(spark):
    with tables.scratch(spark):
        kept = tables.written(spark.range(3), "scratch")
        path = kept.inputFiles()[0]
        assert kept.count() == 3 and src.exists(spark, path)
    assert not src.exists(spark, path)
