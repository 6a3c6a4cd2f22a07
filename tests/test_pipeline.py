import json
from datetime import datetime, timedelta

import numpy as np
import pytest

from barloom.operators import backtest as bt
from barloom.plans import research


@pytest.fixture(scope="module")
def results(spark):
    r = np.random.default_rng(3)
    close = 100 * np.exp(r.normal(0, 0.01, 500).cumsum())
    bars = spark.createDataFrame([("s", datetime(2024, 1, 1) + timedelta(hours=i), float(c), float(c) * 1.01, float(c) * 0.99, float(c), 1.0) for i, c in enumerate(close)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    return research.research(bars, research.Pipeline({"a": 1e3, "b": 1e5}, 60, (5, 10), (20, 400), (1, 4), "b", bt.FxCost(0.7, 0.2), 20, 100))


def test_five_steps(results, tmp_path):
    assert {r.feature for r in results["gate"].collect()} == {"mom", "rv", "level", "slope", "curvature", "spread", "deviation"}
    assert results["ic"].count() == 14 and results["stationarity"].count() == 7 and results["calibration"].count() == 1
    # A mean of 400 rows on a trend of 60 leaves fewer than 100 signals.
    assert sorted((r.lam, r.t1, r.t2) for r in results["grid"].collect()) == [(x, a, 20) for x in ("a", "b") for a in (5, 10)]
    research.report(results, str(tmp_path))
    rows = [json.loads(line) for f in (tmp_path / "grid").glob("*.json") for line in f.read_text().splitlines()]
    assert len(rows) == 4 and all("sharpe" in r for r in rows)


def test_high_count(spark):
    df = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate([(0.1, 5), (0.9, 50), (None, 60), (0.3, 5), (0.2, 70)])], "id int, sharpe double, n_trades int")
    get = lambda least, nearest: [(r.id, r.enough) for r in bt.high_count(df, ["id"], least, nearest).orderBy("place").collect()]
    assert get(50, 10) == [(1, True), (4, True), (2, True)]
    assert get(500, 4) == [(4, False), (2, False), (1, False), (0, False)]
