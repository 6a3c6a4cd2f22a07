from datetime import datetime

import pytest
from pyspark.sql import functions as F

from barloom.operators.difference import differences

T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)
SCHEMA = "k long, v double, w {w}, s string, at timestamp, loaded timestamp, sign int, row string, field int, c int"


def frame(spark, rows, w="long"):
    return spark.createDataFrame([(*r, 1, "r", 1, 1) for r in rows], SCHEMA.format(w=w))


def run(spark, a, b, tolerance=1e-6):
    out = differences(frame(spark, a), frame(spark, b, "double"), "k", ["at", "v", "w", "s"], "loaded", tolerance)
    return sorted(((r.k if r.k is not None else -1), r.difference) for r in out.collect())


def test_each_kind_of_difference(spark):
    a = [(1, 1.0, 5, "x", T0, T0), (2, 1.0, 5, "x", T0, T0), (3, None, 5, None, T0, T0), (4, 1.0, 5, "x", T0, T0), (6, 1.0, None, "x", None, T0)]
    b = [(1, 1.0 + 5e-7, 5.0, "x", T0, T0), (3, 2.0, 5.0, None, T1, T0), (4, 1.00001, 6.0, "y", T0, T0), (5, 1.0, 5.0, "x", T0, T0), (6, 1.0, None, "x", None, T0)]
    assert run(spark, a, b) == [(2, "only_a"), (3, "at"), (3, "v"), (4, "s"), (4, "v"), (4, "w"), (5, "only_b")]


def test_last_loaded_row_is_in_force_and_repeats_count_once(spark):
    a = [(1, 1.0, 5, "x", T0, T0), (1, 2.0, 5, "x", T0, T1), (1, 2.0, 5, "x", T0, T1)]
    b = [(1, 2.0, 5.0, "x", T0, T0), (1, 9.0, 5.0, "x", T0, None)]
    assert run(spark, a, b) == []


def test_null_key_nan_and_empty_sides(spark):
    nan = float("nan")
    assert run(spark, [(None, nan, 1, "", T0, T0)], [(None, nan, 1.0, "", T0, T0)]) == []
    assert run(spark, [(None, nan, 1, "", T0, T0)], [(None, 1.0, 1.0, "", T0, T0)]) == [(-1, "v")]
    assert run(spark, [(7, None, None, None, None, None)], []) == [(7, "only_a")]
    assert run(spark, [], [(7, None, None, None, None, None)]) == [(7, "only_b")]
    assert run(spark, [], []) == []


def test_one_shuffle_each_side_only(spark):
    out = differences(frame(spark, []), frame(spark, [], "double"), "k", ["v"], "loaded")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    import random

    r = random.Random(seed)
    some = lambda: [(r.randrange(12), r.choice([None, 1.0, 1.0 + 4e-7, 2.0]), r.choice([None, 1, 2]), r.choice([None, "", "a"]), r.choice([None, T0]), datetime(2024, 1, 1 + i % 28, i // 28)) for i in range(20)]
    a, b = some(), some()
    force = lambda rows: {row[0]: row for row in sorted(rows, key=lambda x: x[5])}
    x, y, want = force(a), force(b), []
    for k in sorted(x.keys() | y.keys()):
        if k not in y or k not in x:
            want.append((k, "only_a" if k in x else "only_b"))
            continue
        for name, i in (("at", 4), ("v", 1), ("w", 2), ("s", 3)):
            p, q = x[k][i], y[k][i]
            if (p is None) != (q is None) or (p is not None and (abs(p - q) > 1e-6 if name in "vw" else p != q)):
                want.append((k, name))
    assert run(spark, a, [(k, v, None if w is None else float(w), *rest) for k, v, w, *rest in b]) == sorted(want)


@pytest.mark.parametrize("kinds", [("long", "long"), ("long", "decimal(30,2)"), ("decimal(20,0)", "decimal(38,18)"), ("int", "long")])
def test_whole_numbers_are_compared_exactly(spark, kinds):
    big = 7 if "int" in kinds else 1 << 60
    a = spark.createDataFrame([(1, str(big)), (2, str(big)), (3, None), (4, str(-big)), (5, "5")], "k long, v string").withColumn("v", F.col("v").cast(kinds[0]))
    b = spark.createDataFrame([(1, str(big)), (2, str(big + 1)), (3, "1"), (4, str(big)), (5, "5")], "k long, v string").withColumn("v", F.col("v").cast(kinds[1]))
    assert sorted(tuple(r) for r in differences(a, b, "k", ["v"]).collect()) == [(2, "v"), (3, "v"), (4, "v")]
    assert sorted(tuple(r) for r in differences(a, b, "k", ["v"], tolerance=1.0).collect()) == [(3, "v"), (4, "v")]
