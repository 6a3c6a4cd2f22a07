import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.operators import rejects

SCHEMA = "line_id long, file_name string, line_no int, layout string, delim string, line string, reason string, datetime string, open int"
OK = "2024.01.02,03:04,1.0,2,+3.5,-4e-3,5"
CASES = [
    (OK, "broker", None),
    ("2024.01.02,03:04,1.0,2,+3.5,-4e-3,", "broker", None),
    ('"2024.01.02", "03:04" ,\t1.0\t,2,3,4,""\r', "broker", None),
    ('2024.01.02,03:04,1.0,2,3,4,"5', "broker", "quoting"),
    ('2024.01.02,03:04,1.0,2,3,4,"5"x', "broker", "quoting"),
    ('2024.01.02,03:04,1.0,2"2,3,4,5', "broker", "quoting"),
    ('2024.01.02,03:04,1.0,2"2,3"3,4,5', "broker", "quoting"),
    ("2024.01.02,03:04,1.0,2,3,4", "broker", "column_count"),
    (",".join([OK, "6"]), "broker", "column_count"),
    ("", "broker", "column_count"),
    (None, "broker", "column_count"),
    (OK, None, "column_count"),
    (OK, "other", "column_count"),
    (",03:04,1.0,2,3,4,5", "broker", "bad_datetime"),
    ("2024.02.30,03:04,1.0,2,3,4,5", "broker", "bad_datetime"),
    ("2024.02.20,24:00,1.0,2,3,4,5", "broker", "bad_datetime"),
    ("2024-02-20,23:00,1.0,2,3,4,5", "broker", "bad_datetime"),
    ("2024.02.2٠,23:00,1.0,2,3,4,5", "broker", "bad_datetime"),
    ("2024.01.02,03:04,,2,3,4,5", "broker", "bad_value"),
    ("2024.01.02,03:04,1.,2,3,4,5", "broker", "bad_value"),
    ("2024.01.02,03:04,.5,2,3,4,5", "broker", "bad_value"),
    ("2024.01.02,03:04,１,2,3,4,5", "broker", "bad_value"),
    ('2024.01.02,03:04,1.0,2,3,4,"1,0"', "broker", "bad_value"),
    ('2024-01-02 03:04:05,1,2,3,4,,0.0,0.0,"a ""b"", c"', "headed", None),
    ("2024-01-02 03:04:05+02:00,1,2,3,4,5,0.0,0.0,", "headed", None),
    ("2024-01-02 03:04:05Z,1,2,3,4,5,,0.0,", "headed", "bad_value"),
    ("2024-01-02T03:04:05Z,1,2,3,4,5,0,0.0,", "headed", "bad_datetime"),
    ("2024-01-02 03:04:05 +02:00,1,2,3,4,5,0,0.0,", "headed", "bad_datetime"),
    ("2024-01-02 03:04:05,1,2,3,4,5,0.0,0.0," + "x" * 200_000, "headed", None),
]


def run(spark, rows):
    df = spark.createDataFrame([(i, "f", no, layout, delim, line, "r", "d", 1) for i, (no, layout, delim, line) in enumerate(rows)], SCHEMA)
    return {r.line_id: r for r in rejects.parsed(df).collect()}


def test_cases(spark):
    got = run(spark, [(i + 2, layout, ",", line) for i, (line, layout, _) in enumerate(CASES)])
    assert [got[i].reason for i in range(len(CASES))] == [want for _, _, want in CASES]
    assert got[0].close == -0.004 and got[0].datetime.isoformat() == "2024-01-02T03:04:00" and got[0].dividends is None
    assert got[1].volume is None
    assert got[24].datetime.isoformat() == "2024-01-02T01:04:05"


def test_header_mark_and_delimiters(spark):
    got = run(spark, [(1, "headed", ";", '﻿"broken'), (1, "broker", ",", "﻿" + OK), (2, "broker", ",", "﻿" + OK), (3, "broker", ";", OK.replace(",", ";")), (3, "broker", None, OK), (3, "broker", "", OK), (3, "broker", "||", OK)])
    assert {i: r.reason for i, r in got.items()} == {1: None, 2: "bad_datetime", 3: None, 4: None, 5: None, 6: "column_count"}


def test_empty_table(spark):
    assert rejects.parsed(spark.createDataFrame([], SCHEMA)).count() == 0


def by_hand(line: str) -> tuple[bool, int]:
    """Well formed, and the number of fields: a reader of one character after another."""
    i, fields = 0, 0
    blank = " \t\r"
    while True:
        fields += 1
        while i < len(line) and line[i] in blank:
            i += 1
        if i < len(line) and line[i] == '"':
            i += 1
            while True:
                j = line.find('"', i)
                if j < 0:
                    return False, 0
                if line[j + 1 : j + 2] == '"':
                    i = j + 2
                    continue
                i = j + 1
                break
            while i < len(line) and line[i] in blank:
                i += 1
            if i < len(line) and line[i] != ",":
                return False, 0
        else:
            j = line.find(",", i)
            part = line[i:] if j < 0 else line[i:j]
            if '"' in part:
                return False, 0
            i += len(part)
        if i >= len(line):
            return True, fields
        i += 1


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet='a", \té\n', max_size=12), min_size=1, max_size=6))
def test_structure_equals_a_reader_by_hand(lines):
    cut = rejects._cut(pa.array(lines), ",")
    fields = [cut.raw.tobytes()[a:b] for a, b in zip(cut.begins, cut.stops)]
    for i, line in enumerate(lines):
        own = [f.decode().strip(" \t\r") for f in fields[cut.first[i] : cut.last[i]]]
        bad = bool(cut.odd[i]) or any('"' in f and not re.fullmatch(rejects._QUOTED, f) for f in own)
        good, n = by_hand(line)
        assert good == (not bad), line
        if good:
            assert n == len(own)


_ODD = st.sampled_from(["1", "+1.5", "-2e3", "1e999", "", " 7\t", "0" * 320 + "1", "1.", "é", "x", '"3"', '"a""b"', '"', "2024-02-29 23:59:59", "2023-02-29 00:00:00", "2024-13-01 00:00:00Z", "0000-01-01 00:00:00", "2024-01-01 24:00:00", "2024-01-01 10:00:00+05:30", "2024-01-01 10:00:00-24:00", "2024.02.29", "2024.2.29", "23:59", "24:00", "9999-12-31 00:00:00-01:00"])


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["broker", "headed"]), st.sampled_from([",", ";"]), st.lists(st.tuples(st.lists(_ODD, min_size=1, max_size=10), st.booleans()), min_size=1, max_size=8))
def test_columns_equal_single_lines(name, delim, rows):
    """Whole columns and field by field give the same."""
    layout = rejects.LAYOUTS[name]
    base = ["2024.01.02", "03:04", "1", "2", "0.5", "1.5", "7"] if name == "broker" else ["2024-01-02 03:04:05", "1", "2", "0.5", "1.5", "7", "0", "0", "note"]
    lines = [delim.join((base[: len(base) - len(r)] + r if fit else r)) for r, fit in rows] + [delim.join(base)]
    code, at, values = rejects._batch(layout, delim, np.full(len(lines), 5), pa.array(lines))
    cut = rejects._cut(pa.array(lines), delim)
    for i in range(len(lines)):
        own = [cut.raw.tobytes()[a:b].decode() for a, b in zip(cut.begins[cut.first[i] : cut.last[i]], cut.stops[cut.first[i] : cut.last[i]])]
        reason, when, found = rejects._one(layout, own, False, bool(cut.odd[i]), bool(cut.quoted[i]))
        assert code[i] == rejects._CODES[reason], lines[i]
        if reason is None:
            assert at[i] == when and [None if v != v else v for v in values[i].tolist()] == found


@pytest.mark.parametrize("text, good", [("1", True), ("+1.5e-3", True), ("1e", False), ("--1", False), ("1 2", False), ("", False)])
def test_numbers(text, good):
    assert bool(rejects._NUMBER.fullmatch(text)) == good
