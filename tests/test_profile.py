from collections import defaultdict

from pyspark.sql import functions as F

from barloom.operators import profile

SCHEMA = "lot long, price double, note string, flag boolean, ts timestamp, load string, num int, txt string, n int, cell int, bins int"
ROWS = [
    (1, 1.5, "AB123456-0001", True, None, "x", 1, "y", 1, 1, 1),
    (1, 1.5, "AB123456-0001", True, None, "x", 1, "y", 1, 1, 1),
    (1, -2.0, "AB123456-0001\n", None, None, "x", 1, "y", 1, 1, 1),
    (1, None, None, False, None, None, None, None, None, None, None),
    (1, float("nan"), "", False, None, "x", 1, "y", 1, 1, 1),
    (1, 0.0, "", False, None, "x", 1, "y", 1, 1, 1),
    (1, -0.0, "z" * 100_000, False, None, "x", 1, "y", 1, 1, 1),
    (2, 8.0, "b", True, None, "x", 1, "y", 1, 1, 1),
    (None, 3.0, None, True, None, "x", 1, "y", 1, 1, 1),
]


def brute(rows):
    out = defaultdict(lambda: defaultdict(list))
    for r in rows:
        out[r[0]]["price"].append(None if r[1] is None or r[1] != r[1] else r[1])
        out[r[0]]["note"].append(r[2])
    return out


def test_profile_equals_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {(r.load, r.column_name): r for r in profile.profile(df, "lot", ["price", "note", "flag", "ts", "load", "num", "txt", "n", "cell"], {"note": r"^[A-Z]{2}[0-9]{6}-[0-9]{4}\z"}).collect()}
    for load, columns in brute(ROWS).items():
        for c, values in columns.items():
            r = got[load, c]
            there = [v for v in values if v is not None]
            assert (r.n_rows, r.n_nulls, r.n_distinct) == (len(values), len(values) - len(there), len(set(there)))
            assert sum(r.bins.values()) == len(there)
            if c == "price":
                assert (r.n_zeros, r.n_negative) == (sum(v == 0 for v in there), sum(v < 0 for v in there))
                assert r.min_num == min(there) and r.max_num == max(there)
            else:
                assert r.min_txt == (min(there) if there else None)
    assert got[1, "note"].n_unmatched == 4  # a trailing line feed, two empty ones and the long one
    assert got[1, "ts"].n_nulls == 7 and got[1, "ts"].n_distinct == 0 and got[1, "ts"].mean_num is None


def test_compared_and_issues(spark):
    rows = [(0, float(v)) for v in range(1, 101)] + [(1, 1000.0)] * 50 + [(2, float(v)) for v in range(1, 101)]
    df = spark.createDataFrame(rows, "lot long, v double")
    base = spark.createDataFrame([(1, 0), (2, 0), (0, None), (2, 0)], "load long, baseline long")
    both = profile.compared(profile.profile(df, "lot", ["v"]), base)
    by = {r.load: r for r in both.collect()}
    assert by[0].psi is None and by[0].base_distinct is None
    assert by[2].psi == 0 and by[2].chi2 == 0 and by[1].psi > 1 and by[1].chi2 > 100
    limits = {"few": {"v": F.col("n_distinct") * 10 < F.col("base_distinct")}, "high": {"v": F.col("mean_positive") > F.col("base_mean_positive") * 4}}
    assert sorted((r.load, r.column_name, r.issue) for r in profile.issues(both, limits).collect()) == [(1, "v", "few"), (1, "v", "high")]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert profile.profile(df, "lot", ["price", "note"]).count() == 0


def test_stability_index_and_chi_square_by_hand(spark):
    import math

    rows = [(0, v) for v in [0.5] * 30 + [1.5] * 50 + [3.0] * 20] + [(1, v) for v in [1.5] * 10 + [3.0] * 25 + [-3.0] * 5]
    df = spark.createDataFrame(rows, "lot long, v double")
    r = profile.compared(profile.profile(df, "lot", ["v"]), spark.createDataFrame([(1, 0)], "load long, baseline long")).where("load = 1").first()
    x, y = [0, 10, 25, 5], [30, 50, 20, 0]  # bins of 0.5, 1.5, 3 and -3
    p = [(a + 0.5) / (40 + 2) for a in x]
    q = [(a + 0.5) / (100 + 2) for a in y]
    assert math.isclose(r.psi, sum((a - b) * math.log(a / b) for a, b in zip(p, q)))
    assert math.isclose(r.chi2, sum((a * math.sqrt(100 / 40) - b * math.sqrt(40 / 100)) ** 2 / (a + b) for a, b in zip(x, y)))


def distances_by_hand(rows, base):
    """(psi, chi2, cells) of two lists of values, by value for texts and by the baseline's deciles for numbers."""
    import math

    rows, base = ([v for v in side if v is not None and v == v] for side in (rows, base))
    if not all(isinstance(v, str) for v in rows + base):
        q = [sorted(base)[i * (len(base) - 1) // 10] for i in range(11)]
        heavy = [a for a, b in zip(q, q[1:]) if a == b]
        cell = lambda v: (v >= q[0], *(v > e for e in q[1:]), *(v >= e for e in heavy))
        rows, base = [cell(v) for v in rows], [cell(v) for v in base]
    cells = sorted(set(rows) | set(base))
    x, y = [rows.count(c) for c in cells], [base.count(c) for c in cells]
    n, m, w = sum(x), sum(y), len(cells)
    p, q = [(a + 0.5) / (n + w / 2) for a in x], [(b + 0.5) / (m + w / 2) for b in y]
    return sum((a - b) * math.log(a / b) for a, b in zip(p, q)), sum((a * math.sqrt(m / n) - b * math.sqrt(n / m)) ** 2 / (a + b) for a, b in zip(x, y)), w


def test_distances_equal_brute_force(spark):
    import math
    import random
    from datetime import datetime, timedelta

    r = random.Random(3)
    at = datetime(2024, 1, 1)
    make = lambda load, n, low, high, names, hours: [(load, r.choice([round(r.uniform(low, high), 3), 1.25, -2.0, 1e-9]), r.choice(names), at + timedelta(seconds=r.randrange(hours * 3600)), None) for _ in range(n)]
    loads = {0: make(0, 80, 1.0, 1.1, ["AAA", "BBB"], 5), 1: make(1, 60, 1.0, 1.1, ["AAA", "BBB"], 5), 2: make(2, 50, 1.8, 1.99, ["CCC", "DDD"], 9), 3: make(3, 5, 1, 2, ["AAA"], 1)}
    loads[2] += [(2, float("nan"), None, None, None), (2, None, None, None, None)]
    df = spark.createDataFrame([v for rows in loads.values() for v in rows], "lot long, num double, txt string, q timestamp, baseline string")
    base = spark.createDataFrame([(0, None), (1, 0), (2, 0), (2, None), (3, 9), (7, 0)], "load long, baseline long")
    got = {(v.load, v.column_name): v for v in profile.distances(df, "lot", ["num", "txt", "q", "baseline"], base).collect()}
    assert {k for k, _ in got} == {1, 2, 3} and len(got) == 12
    for load in (1, 2):
        for place, name in ((1, "num"), (2, "txt"), (3, "q")):
            take = lambda rows: [v[place].timestamp() if name == "q" and v[place] else v[place] for v in rows]  # noqa: B023, E731
            psi, chi2, cells = distances_by_hand(take(loads[load]), take(loads[0]))
            v = got[load, name]
            assert math.isclose(v.psi, psi, abs_tol=1e-9) and math.isclose(v.chi2, chi2, abs_tol=1e-9) and v.n_cells == cells
    assert got[2, "baseline"].psi is None and got[2, "baseline"].n_values == 0 and got[2, "num"].n_values == 50
    assert got[3, "num"].psi is None and got[3, "num"].base_values is None and got[3, "num"].n_values == 5


def test_distances_see_what_fixed_bins_hide(spark):
    rows = [(0, 1.05, "EURUSD")] * 40 + [(1, 1.95, "GBPUSD")] * 40
    df, base = spark.createDataFrame(rows, "lot long, v double, s string"), spark.createDataFrame([(1, 0)], "load long, baseline long")
    fixed = profile.compared(profile.profile(df, "lot", ["v", "s"]), base).where("load = 1").collect()
    assert [r.psi for r in fixed] == [0, 0]
    assert all(r.psi > 5 and r.chi2 == 80 for r in profile.distances(df, "lot", ["v", "s"], base).collect())


def test_large_whole_numbers_and_decimals_stay_apart(spark):
    from decimal import Decimal

    rows = [(1, (1 << 60) + i % 100, Decimal(1 << 60) + Decimal(i % 50) / 100, -(1 << 63)) for i in range(200)]
    got = {r.column_name: r for r in profile.profile(spark.createDataFrame(rows, "lot long, id long, sum decimal(30,2), least long"), "lot", ["id", "sum", "least"]).collect()}
    assert (got["id"].n_distinct, got["sum"].n_distinct, got["least"].n_distinct) == (100, 50, 1)
    assert got["id"].min_txt is None and got["sum"].max_txt is None and got["id"].n_nulls == 0
