import itertools
import random
from datetime import datetime, timezone

import pytest

from barloom.functions.timetext import interpretations
from barloom.operators import instants


def us(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1_000_000)


@pytest.mark.parametrize(
    "text, tz, order, want",
    [
        ("2024-01-02 03:04:05", None, "ymd", us(2024, 1, 2, 3, 4, 5)),
        ("2024-01-02 03:04:05.1234567", None, "ymd", us(2024, 1, 2, 3, 4, 5, 123456)),
        ("\t2024-01-02T03:04:05,5 +02:00 ", "Asia/Tokyo", "ymd", us(2024, 1, 2, 1, 4, 5, 500000)),
        ("2024-01-02 03:04:05 UTC-05:00", "Asia/Tokyo", "ymd", us(2024, 1, 2, 8, 4, 5)),
        ("2024-01-02 03:04:05z", "Asia/Tokyo", "ymd", us(2024, 1, 2, 3, 4, 5)),
        ("2024-07-02 03:04:05 EST", "America/New_York", "ymd", us(2024, 7, 2, 8, 4, 5)),
        ("2024-07-02 03:04:05 EDT", "America/New_York", "ymd", us(2024, 7, 2, 7, 4, 5)),
        ("2024-07-02 03:04:05 JST", "America/New_York", "ymd", None),
        ("2024-01-02", "Europe/Berlin", "dmy", us(2024, 1, 1, 23)),
        ("20240102T030405", None, "dmy", us(2024, 1, 2, 3, 4, 5)),
        ("20240102 030405", None, "dmy", us(2024, 1, 2, 3, 4, 5)),
        ("02/03/2024 1:05 p.m.", None, "dmy", us(2024, 3, 2, 13, 5)),
        ("02/03/2024 12:05 am", None, "mdy", us(2024, 2, 3, 0, 5)),
        ("02/03/2024 13:05 pm", None, "mdy", None),
        ("02/03/2024 0:05 am", None, "mdy", None),
        ("31/12/24 10:00:00", None, "dmy", us(2024, 12, 31, 10)),
        ("31/12/24 10:00:00", None, "mdy", None),
        ("5-Mar-2024 01:02:03", None, "mdy", us(2024, 3, 5, 1, 2, 3)),
        ("05-MAR-2024 01:02:03", None, "mdy", us(2024, 3, 5, 1, 2, 3)),
        ("Mar 5, 2024 01:02:03", None, "dmy", us(2024, 3, 5, 1, 2, 3)),
        ("1700000000", "Asia/Tokyo", "dmy", 1_700_000_000_000_000),
        ("1700000000123", None, "dmy", 1_700_000_000_123_000),
        ("1700000000123456", None, "dmy", 1_700_000_000_123_456),
        ("2024-03-10 02:30:00", "America/New_York", "ymd", None),
        ("2024-11-03 01:30:00", "America/New_York", "ymd", us(2024, 11, 3, 5, 30)),
        ("2024-11-03 01:30:00 EST", "America/New_York", "ymd", us(2024, 11, 3, 6, 30)),
        ("2024-02-30 00:00:00", None, "ymd", None),
        ("2024-02-20 24:00:00", None, "ymd", None),
        ("2024-02-20 23:59:60", None, "ymd", None),
        ("2024-02", None, "ymd", None),
        ("10:20:30", None, "ymd", None),
        ("n/a", None, "ymd", None),
        ("", None, "ymd", None),
        (None, None, "ymd", None),
        ("2024-01-02 03:04:05", "Mars/Base", "ymd", None),
    ],
)
def test_one_meaning(text, tz, order, want):
    assert [t for _, t in interpretations(text, tz, order)] == ([] if want is None else [want])


def test_both_of_a_double_hour_and_all_orders():
    assert [t for _, t in interpretations("2024-11-03 01:30:00", "America/New_York", "ymd", both=True)] == [us(2024, 11, 3, 5, 30), us(2024, 11, 3, 6, 30)]
    assert {t for _, t in interpretations("02/03/2024 00:00:00", None, None)} == {us(2024, 3, 2), us(2024, 2, 3)}


SCHEMA = "stamp_id long, symbol string, tz string, day_order string, date string, time string, datetime string, id string, source string, forms int, block int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "i", "s", 1, 1) for r in rows], SCHEMA)


def test_texts_of_two_columns_and_nulls(spark):
    rows = [
        (1, "a", None, "ymd", "2024.01.02", "03:04", None),
        (2, "a", None, "ymd", "2024.01.02", None, None),
        (3, "a", None, "ymd", None, "03:04", None),
        (4, None, None, None, None, None, None),
        (5, None, None, "ymd", "2024.01.02", "03:04", ""),
        (6, None, None, None, "x" * 100_000, "y", None),
    ]
    got = {r.id: r.utc_us for r in instants.normalised(frame(spark, rows), "symbol", "stamp_id").collect()}
    assert got == {1: us(2024, 1, 2, 3, 4), 2: us(2024, 1, 2)}
    assert instants.normalised(frame(spark, []), "symbol", "stamp_id").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_path_equals_brute_force_over_blocks(spark, seed):
    r = random.Random(seed)
    rows, at = [], datetime(2024, 1, 1)
    for i in range(9):
        day = f"{r.randrange(1, 14):02d}/{r.randrange(1, 13):02d}/2024"
        rows.append((i, "s", None, None, None, None, r.choice([f"{day} 10:00:00", f"{day} 10:00:00", "2024-05-06 01:00:00"])))
    options = [interpretations(x[6], None, None) for x in rows]
    kept = [(i, o) for i, o in enumerate(options) if o]
    cost = lambda path: sum((a[0] != b[0]) * instants.SWITCH + (a[1] > b[1]) * instants.BACK for a, b in zip(path, path[1:]))
    best = min(cost(p) for p in itertools.product(*[o for _, o in kept]))
    for block in (2, 3, 100):
        got = {x.id: (x.form, x.utc_us) for x in instants.normalised(frame(spark, rows), "symbol", "stamp_id", block_rows=block).collect()}
        path = [got[i] for i, _ in kept]
        assert all(p in o for p, (_, o) in zip(path, kept)) and cost(path) == best
    assert at
