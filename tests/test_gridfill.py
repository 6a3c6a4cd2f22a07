import random
from datetime import datetime, timedelta

import pytest

from barloom.operators import gridfill

LIST = "provider string, symbol string, window_start timestamp, window_end timestamp, step_minutes int, trading_session string, slot int, at int"
READ = "provider string, symbol string, ts timestamp, close double, slot int, step int, v int, stretch int, t int"
T = datetime(2024, 1, 5, 20)  # a Friday


def run(spark, readings, listings, gap=240, stretch=1 << 20):
    a = spark.createDataFrame([(*r, 1, 1, 1, 1, 1) for r in readings], READ)
    b = spark.createDataFrame([(*r, 1, 1) for r in listings], LIST)
    return sorted(((r.provider or "", r.symbol or "", r.slot, r.missing, r.value) for r in gridfill.on_grid(a, b, "close", gap, stretch).collect()), key=str)


def brute(readings, listings, gap):
    out = []
    epoch = datetime(1970, 1, 1)
    us = lambda t: int((t - epoch) / timedelta(microseconds=1))
    for p, s, a, b, step, session in set(listings):
        if a is None or b is None or not step or step < 1:
            continue
        own = sorted((us(t), v) for q, z, t, v in readings if (q, z) == (p, s) and t is not None and v is not None and v == v)
        t = a
        while t < b:
            if session != "fx" or t.weekday() < 5 or (t.weekday() == 6 and t.hour >= 22):
                x = us(t)
                before = [r for r in own if r[0] < x]
                after = [r for r in own if r[0] >= x]
                missing = not after or after[0][0] >= x + step * 60_000_000
                value = None
                if after and after[0][0] == x:
                    value = after[0][1]
                elif before and after and after[0][0] - before[-1][0] <= gap * 60_000_000:
                    (t0, v0), (t1, v1) = before[-1], after[0]
                    value = v0 + (v1 - v0) * ((x - t0) / (t1 - t0))
                out.append((p or "", s or "", x // 1_000_000, missing, value))
            t += timedelta(minutes=step)
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, stretch", [(0, 1 << 20), (1, 3600 * 5), (2, 3600 * 7)])
def test_equals_brute_force(spark, seed, stretch):
    r = random.Random(seed)
    listings = [("p", "a", T, T + timedelta(hours=70), 60, "fx"), ("p", "b", T, T + timedelta(hours=9), 15, "24x7"), ("q", "a", T, T + timedelta(hours=5), 60, None), ("p", "a", T, T + timedelta(hours=70), 60, "fx")]
    readings = [(r.choice("pq"), r.choice("abc"), T + timedelta(minutes=r.randrange(-300, 4500), microseconds=r.choice([0, 1])), r.choice([None, float("nan"), 1.0, 2.5, 4.0])) for _ in range(300)]
    readings += readings[:20] + [("p", "b", T, 1.0), ("p", "b", T, 2.0)]
    assert run(spark, readings, listings, 90, stretch) == brute(readings, listings, 90)


def test_nulls_and_empty_tables(spark):
    listing = ("p", "a", T, T + timedelta(hours=2), 60, "24x7")
    assert run(spark, [], [listing]) == brute([], [listing], 240)
    assert run(spark, [("p", "a", T, 1.0)], []) == []
    broken = [("p", "a", None, T, 60, "fx"), ("p", "a", T, None, 60, "fx"), ("p", "a", T, T, 60, "fx"), ("p", "a", T, T + timedelta(hours=1), None, "fx"), ("p", "a", T, T + timedelta(hours=1), 0, "fx")]
    assert run(spark, [("p", "a", None, 1.0), (None, None, T, 1.0)], broken) == []
