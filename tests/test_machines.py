import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import machines
from barloom.operators.machines import crossing_step, residency_step

T = datetime(2024, 1, 1)


def frame(spark, x):
    return spark.createDataFrame([("s", T + timedelta(hours=i), None if v is None else float(v)) for i, v in enumerate(x)], "symbol string, ts timestamp_ntz, x double")


def run(spark, x, sigma, hold, confirm=0, lookback=3, crossing=False):
    out = machines.threshold_signals(frame(spark, x), "x", "sig", sigma, hold, confirm, lookback, crossing)
    return [r.sig for r in out.orderBy("ts").collect()]


def test_traces(spark):
    assert run(spark, [0, 0.5, 0, -3, None, 0, 0], 1, 10) == [0, 0, 0, 1, 1, 1, 1]
    assert run(spark, [0, 1, 0, -3, -2.5], 1, 1) == [0, 0, 0, 1, 0]
    assert run(spark, [0, 0.5, 0, -3, None, 0, 0], 1, 10, crossing=True) == [0, 0, 0, 1, 1, 1, 1]
    assert run(spark, [0, 0.5, 0, -3, 0, -3], 1, 2, crossing=True) == [0, 0, 0, 1, 1, 0]


def slow(x, spread, sigma, hold, confirm, crossing):
    """One row after another."""
    out, pos, age, side0, run, locked = [], 0, 0, 0, (0, 0), False
    for v, s in zip(x, spread):
        usable = v == v and s == s and s != 0
        side = 0 if not usable else 1 if v > sigma * s else -1 if v < -sigma * s else 0
        age += pos != 0
        if usable:
            locked = False
            if pos and (side == pos or age >= hold):
                pos, age, run, locked = 0, 0, (0, 0), True
            if not pos and not locked:
                if crossing:
                    if side and side != side0:
                        pos, age = -side, 0
                else:
                    run = (side, run[1] + 1 if side == run[0] else 1) if side else (0, 0)
                    if side and run[1] > confirm:
                        pos, age, run = -side, 0, (0, 0)
            side0 = side
        elif not pos:
            run = (0, 0)
        out.append(float(pos))
    return out


@pytest.mark.parametrize("crossing", [False, True])
@pytest.mark.parametrize("block", [1, 2, 5, 1000])
def test_jumps_equal_steps_in_any_blocks(crossing, block):
    r = random.Random(block)
    for trial in range(150):
        n, hold, confirm = 60, r.randrange(1, 6), r.randrange(0, 3)
        x = np.array([r.choice([np.nan, -2.0, -2.0, -0.5, 0.0, 0.5, 2.0, 2.0]) for _ in range(n)])
        spread = np.array([r.choice([np.nan, 0.0] + [1.0] * 12) for _ in range(n)])
        step = crossing_step("x", "sp", "sg", "h", "o") if crossing else residency_step("x", "sp", "sg", "h", "c", "o")
        state, got = {}, []
        for a in range(0, n, block):
            k = len(x[a : a + block])
            got += step({"x": x[a : a + block], "sp": spread[a : a + block], "sg": np.ones(k), "h": np.full(k, hold), "c": np.full(k, confirm)}, state)["o"].tolist()
        assert got == slow(x, spread, 1.0, hold, confirm, crossing), (trial, hold, confirm)


def test_entry_filter(spark):
    rows = [(1, True), (1, False), (1, True), (-1, True), (0, True), (-1, True), (1, True), (0, None), (1, None), (1, True)]
    df = spark.createDataFrame([("s", T + timedelta(hours=i), float(a), b) for i, (a, b) in enumerate(rows)], "symbol string, ts timestamp_ntz, sig double, ok boolean")
    assert [r.out for r in machines.entry_filter(df, "sig", "ok", "out").orderBy("ts").collect()] == [1, 0, 0, 0, 0, -1, 1, 0, 0, 0]


def test_gates(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (1.0, None, None), (-1.0, 2.0, -2.0), (1.0, 1.0, -2.0), (-1.0, 1.0, 2.0)], "s double, r double, d double")
    c = F.col
    rows = df.select(machines.regime_gate(c("s"), c("r")), machines.exhaustion_filter(c("s"), c("d")), machines.vol_floor(c("s"), c("r"), 1.5), machines.regime_switch(c("r"), F.lit(5.0), c("d"), 1.5, 2.0)).collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0, 5), (0, 1, 0, 0), (0, 0, -1, -2), (1, 1, 0, 5), (-1, -1, 0, 5)]
