import random
from datetime import datetime, timedelta
from statistics import median

import pytest

from barloom.operators import spikes

SCHEMA = "bar_id long, provider string, symbol string, ts timestamp, open double, high double, low double, close double, kind string, stretch int, own int, far int"
T = datetime(2024, 1, 1)


def run(spark, rows, stretch=1 << 21, **more):
    df = spark.createDataFrame([(*r, "k", 1, 1, 1) for r in rows], SCHEMA)
    return {r.bar_id: r.kind for r in spikes.implausible(df, stretch_s=stretch, **more).collect()}


def brute(rows, times=27.0, run_of=8):
    first = {}
    for r in sorted(rows):
        first.setdefault(r[1:4], r)
    series = {}
    for r in first.values():
        if r[3] is not None and r[7] is not None and r[7] == r[7]:
            series.setdefault(r[1:3], []).append(r)
    out = {}
    for own in series.values():
        own.sort(key=lambda r: r[3])
        close = [r[7] for r in own]
        change = [abs(b - a) for a, b in zip(close, close[1:])]
        for i, (n, _, _, _, o, h, lo, c) in enumerate(own):
            prices = [None if x is None or x != x else x for x in (o, h, lo, c)]
            o, h, lo, c = prices
            bad = any(x is not None and x <= 0 for x in prices)
            bad |= h is not None and any(x is not None and h < x for x in (o, c, lo)) or lo is not None and any(x is not None and lo > x for x in (o, c))
            m = median(close[max(0, i - 5) : i + 6])
            far = max(abs(x - m) for x in (h, lo, c) if x is not None)
            a = b = i
            while a > 0 and close[a - 1] == c:
                a -= 1
            while b + 1 < len(close) and close[b + 1] == c:
                b += 1
            if bad:
                out[n] = "impossible"
            elif change and far > times * median(change):
                out[n] = "spike"
            elif b - a + 1 >= run_of:
                out[n] = "stuck"
    return out


def some(seed, n=400):
    r = random.Random(seed)
    rows, price = [], 100.0
    for i in range(n):
        price += r.choice([-0.25, 0.25, 0.5, -0.5, 0.0])
        c = 100.0 if 100 <= i % 200 < 112 else price
        if r.random() < 0.03:
            c = price * r.choice([1.5, 0.5, -1.0])
        t = T + timedelta(minutes=15 * i) if r.random() < 0.9 else T + timedelta(minutes=15 * r.randrange(n))
        pick = lambda x: r.choice([x] * 9 + [None])
        rows.append((i, r.choice(["p", None]), r.choice(["a", "a", "b"]), t, pick(c), pick(c + 0.5), pick(c - 0.5), pick(c)))
    return rows


@pytest.mark.parametrize("seed, stretch", [(0, 1 << 21), (1, 3600), (2, 1800), (3, 36_000)])
def test_equals_brute_force_however_series_are_cut(spark, seed, stretch):
    rows = some(seed)
    assert run(spark, rows, stretch) == brute(rows)


def test_small_cases(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, "p", "a", T, 1.0, 1.0, 1.0, 1.0), (2, None, None, None, 1.0, 1.0, 1.0, 1.0), (3, "p", "a", T, 0.0, 0.0, 0.0, 0.0)]) == {}
    assert run(spark, [(1, "p", "a", T, float("nan"), None, None, float("nan"))]) == {}
    still = [(i, "p", "a", T + timedelta(hours=i), 1.0, 1.0, 1.0, 1.0) for i in range(8)]
    assert run(spark, still) == {i: "stuck" for i in range(8)} and run(spark, still[:7]) == {}


def test_exact_medians(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 0.0, 0.0, 1e-300, 0.1, 0.2, 0.30000000000000004, 0.3, 5.0])) for _ in range(200)]
    got = {x.k: x.median for x in spikes.exact_medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got == {k: median(v for q, v in rows if q == k and v is not None) for k in ("a", "b", None)}
