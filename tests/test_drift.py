from datetime import datetime

from barloom.operators import drift

T = [datetime(2024, 1, d) for d in range(1, 9)]
SCHEMA = "record_id long, file_no long, provider string, loaded_at timestamp, record_json string, name string, kind string, field string, seq int"
ALIASES = [("volume", "volume"), ("vol", "volume"), ("close", "close"), ("c", "close"), ("datetime", "datetime"), (None, "x"), ("vol", "volume")]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "n", "k", "f", 1) for i, r in enumerate(rows)], SCHEMA)


def aliases(spark):
    return spark.createDataFrame([(*a, 1) for a in ALIASES], "alias string, field string, name int")


def run(spark, rows):
    return sorted((r.file_no, r.field, r.change_kind) for r in drift.changes(frame(spark, rows), aliases(spark)).collect())


def test_every_kind_of_change(spark):
    rows = [
        (10, "p", T[0], '{"Close": 1, "Vol": 2, "x": 1}'),
        (10, "p", T[0], '{"Close": null, "Vol": 2.5}'),
        (5, "p", T[1], '{" CLOSE ": 1.0, "volume": 2.5}'),
        (6, "p", T[2], '{"close": null, "volume": "2", "x": true}'),
        (7, "p", T[3], '{"close": 2e0, "volume": "2", "x": "y"}'),
        (1, "q", T[5], '{"other": 1}'),
        (2, "q", T[4], '{"other": 1}'),
    ]
    assert run(spark, rows) == [(5, "close", "type_changed"), (5, "volume", "renamed"), (5, "x", "removed"), (6, "volume", "type_changed"), (6, "x", "added")]


def test_nulls_repeats_and_texts_that_are_no_object(spark):
    rows = [(1, None, T[0], '{"a": 1}'), (1, None, T[0], '{"a": 1}'), (2, None, T[1], None), (3, None, T[2], "[1]"), (4, None, T[3], "{"), (5, None, T[4], '{"a": 1, "A ": "s"}'), (6, None, None, "{}")]
    assert run(spark, rows) == [(1, "a", "added"), (2, "a", "removed"), (5, "a", "added"), (5, "a", "type_changed")] or run(spark, rows) == [(1, "a", "added"), (2, "a", "removed"), (5, "a", "added")]
    assert run(spark, []) == []


def test_types(spark):
    kinds = {(r.name, r.kind): r.n for r in drift.tagged_types(frame(spark, [(1, "p", T[0], '{"a": 1, "b": 1.0, "c": 1e3, "d": "", "e": null, "f": [1], "g": {"h": 1}, "i": false, "A": 2}')])).collect()}
    assert kinds == {(None, None): 1, ("a", "long"): 2, ("b", "double"): 1, ("c", "double"): 1, ("d", "string"): 1, ("e", "null"): 1, ("f", "array"): 1, ("g", "object"): 1, ("i", "boolean"): 1}


def test_one_table(spark):
    rows = [
        (1, "p", T[0], '{"Close": " 1.5 ", "vol": 7, "datetime": "2024-01-02T03:04:05Z", "z": 1}'),
        (1, "p", T[0], '{"c": null, "close": 2, "Vol": "x", "datetime": 1700000000}'),
        (1, "p", T[0], None),
        (1, "p", T[0], '{"close": "' + "9" * 100_000 + '"}'),
    ]
    got = {r.record_id: r for r in drift.consolidated(frame(spark, rows), aliases(spark), ("close", "volume"), ("datetime",)).collect()}
    assert (got[0].close, got[0].close_as, got[0].volume, got[0].datetime, got[0].rest) == (1.5, "string", 7.0, "2024-01-02 03:04:05", {"z": "1"})
    assert (got[1].close, got[1].volume, got[1].volume_as, got[1].datetime, got[1].rest) == (2.0, None, "string", "2023-11-14 22:13:20", {"volume": "x"})
    assert got[2].close is None and got[2].close_as is None and got[3].close == float("inf")


def test_a_time_keeps_its_parts_or_its_text(spark):
    texts = ['"02.01.2024 10:00"', "1700000000123", "1700000000123456", "123456789012345678", "1700000000123.25", "1700000000.5", "1.7e9", '"2024-01-02 03:04:05.000007"', "-1", '" 2024-01-02 "', '""', "true", "null", "NaN"]
    df = frame(spark, [(1, "p", T[0], '{"datetime": ' + t + "}") for t in texts])
    got = {r.record_id: (r.datetime, r.rest) for r in drift.consolidated(df, aliases(spark), ("close",), ("datetime",)).collect()}
    want = [(None, "02.01.2024 10:00"), ("2023-11-14 22:13:20.123", None), ("2023-11-14 22:13:20.123456", None), (None, "123456789012345678"), ("2023-11-14 22:13:20.12325", None), ("2023-11-14 22:13:20.5", None), ("2023-11-14 22:13:20", None), ("2024-01-02 03:04:05.000007", None), ("1969-12-31 23:59:59", None)]
    want += [("2024-01-02 00:00:00", None), (None, ""), (None, "true"), (None, None), (None, "NaN")]
    assert [got[i] for i in range(len(texts))] == [(t, {} if x is None else {"datetime": x}) for t, x in want]


def test_branches_keep_values_as_written(spark):
    values = ['"007"', "9007199254740993", "1.5", "true", "null", '{"a": [1, {"b": null}], "a": 1.50}', "123456789012345678901234567890"]
    df = frame(spark, [(1, "p", T[0], '{"close": ' + v + ', "z": ' + v + "}") for v in values])
    got = {r.record_id: r for r in drift.consolidated(df, aliases(spark), ("close",), ()).collect()}
    branch = [None if got[i].close_branch is None else {k: v for k, v in got[i].close_branch.asDict().items() if v is not None} for i in range(len(values))]
    assert branch == [{"string": "007"}, {"long": 9007199254740993}, {"double": 1.5}, {"other": "true"}, None, {"other": values[5]}, {"other": values[6]}]
    assert [got[i].rest["z"] for i in range(len(values))] == ["007", *values[1:4], None, *values[5:]]
    assert got[0].close == 7.0 and got[5].close is None and got[5].rest["close"] == values[5]


def test_new_alternatives_by_path(spark):
    deep = '{"x": ' + "[" * 300 + "]" * 300 + "}"
    rows = [(1, "p", T[0], '{"Vol": "a", "g": {"h": 1}}'), (2, "p", T[1], '{"volume": 1, "g": {"H ": [1.5, {"k.l": null}]}}'), (3, "p", T[2], '{"vol": 2, "g": {"h": 2}, "v": []}'), (9, None, T[0], deep), (8, None, T[1], deep), (7, "p", T[3], "{")]
    got = sorted((r.file_no, r.path, r.kind) for r in drift.alternatives(frame(spark, rows), aliases(spark)).collect())
    assert got == [(2, "g.h", "array"), (2, "g.h[]", "double"), (2, "g.h[]", "object"), (2, 'g.h[]."k.l"', "null"), (2, "volume", "long"), (3, "v", "array")]
    assert drift.alternatives(frame(spark, []), aliases(spark)).count() == 0


def test_shapes_equal_the_values_kinds():
    texts = [None, "", "[1]", '{"a": 1, "A ": 1.0, "b": 1e5, "c": "x", "d": null, "e": true, "f": {"g": 1}, "h": [1], "i": NaN, "i": -0}', '{"n": ' + "9" * 5000 + "}", '{"x": 1', "7"]
    for t in texts:
        assert drift._shape(t) == tuple((n, drift._kind(v)) for n, v in drift._pairs(t) or ())
