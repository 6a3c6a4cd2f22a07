"""Lines that fail to parse, each with one reason, beside the lines that load (problem 2).

The lines of a batch are one byte buffer with a separator line feed after each. A mask of quotes and its running
parity, taken from each line's start, locate the delimiters outside quotes; fields are cut at those in NumPy. Lines
without a quote are then counted, checked and converted as whole columns; only those with one, and first lines, are
looked at field by field. A line is well formed under the quoting rule exactly if its parity is even at its end and each
of its fields, so cut, is either free of quotes or one quoted whole: any field before the first fault is cut the same by
both readings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

REASONS = ("quoting", "column_count", "bad_datetime", "bad_value")
_NUMBER = re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?", re.ASCII)
_QUOTED = re.compile(r'"(?:[^"]|"")*"', re.ASCII)
_DAY_TIME = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})(?:Z|([+-])([0-9]{2}):([0-9]{2}))?", re.ASCII)
_DAY = re.compile(r"([0-9]{4})\.([0-9]{2})\.([0-9]{2})", re.ASCII)
_TIME = re.compile(r"([0-9]{2}):([0-9]{2})", re.ASCII)
_EPOCH = date(1970, 1, 1).toordinal()


@dataclass(frozen=True)
class Layout:
    """fields: names in order. numbers: those that must be numbers. empty: numbers that may be empty. headed: line 1 is
    a header, never data. when: `split` (date YYYY.MM.DD and time HH:MM) or `joined` (one datetime with an optional zone)."""

    fields: tuple[str, ...]
    numbers: tuple[str, ...]
    empty: tuple[str, ...]
    headed: bool
    when: str


BROKER = Layout(("date", "time", "open", "high", "low", "close", "volume"), ("open", "high", "low", "close", "volume"), ("volume",), False, "split")
HEADED = Layout(
    ("datetime", "open", "high", "low", "close", "volume", "dividends", "stock_splits", "note"),
    ("open", "high", "low", "close", "volume", "dividends", "stock_splits"),
    ("volume",),
    True,
    "joined",
)
LAYOUTS = {"broker": BROKER, "headed": HEADED}


def _second(year: str, month: str, day: str, hour: str, minute: str, second: str = "0") -> int | None:
    """Seconds since 1970 of a real date and time."""
    h, m, s = int(hour), int(minute), int(second)
    if h > 23 or m > 59 or s > 59:
        return None
    try:
        return (date(int(year), int(month), int(day)).toordinal() - _EPOCH) * 86400 + h * 3600 + m * 60 + s
    except ValueError:
        return None


def _instant(layout: Layout, values: list[str]) -> int | None:
    """Microseconds since 1970 UTC of a line's time, or None. Without a zone it counts as UTC."""
    if layout.when == "split":
        day, time = _DAY.fullmatch(values[0]), _TIME.fullmatch(values[1])
        at = _second(*day.groups(), *time.groups()) if day and time else None
    else:
        found = _DAY_TIME.fullmatch(values[0])
        at = _second(*found.groups()[:6]) if found else None
        if at is not None and found[7]:
            if int(found[8]) > 23 or int(found[9]) > 59:
                return None
            at -= (1 if found[7] == "+" else -1) * (int(found[8]) * 3600 + int(found[9]) * 60)
    return None if at is None else at * 1_000_000


@dataclass
class _Cut:
    """Structure of lines: the bytes; where each field begins and stops; the places of each line's first field among them
    and one past its last; is the parity odd at the line's end; does it hold a quote."""

    raw: np.ndarray
    begins: np.ndarray
    stops: np.ndarray
    first: np.ndarray
    last: np.ndarray
    odd: np.ndarray
    quoted: np.ndarray


def _cut(lines: pa.Array, delim: str) -> _Cut:
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines.cast(pa.binary())), b"\n")
    raw = np.frombuffer(joined[0].as_py() + b"\n", np.uint8)
    lengths = pc.binary_length(lines.cast(pa.binary())).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    quotes = np.cumsum(raw == 34)
    before = quotes[starts] - (raw[starts] == 34)
    line_of = np.repeat(np.arange(len(lengths)), lengths + 1)
    outside = ((quotes - before[line_of]) & 1) == 0
    mark = np.zeros(len(raw), bool)
    mark[ends] = True
    mark |= (raw == ord(delim)) & outside
    stops = np.flatnonzero(mark)
    last = np.searchsorted(stops, ends, "right")
    first = np.concatenate(([0], last[:-1])) if len(last) else last
    begins = np.concatenate(([0], stops[:-1] + 1)) if len(stops) else stops
    n_quotes = quotes[ends] - before
    return _Cut(raw, begins, stops, first, last, (n_quotes & 1) == 1, n_quotes > 0)


def _one(layout: Layout, own: list[str], opening: bool, odd: bool, quoted: bool) -> tuple[str | None, int | None, list | None]:
    """(reason, microseconds, values in the order of layout.numbers) of one line's fields; opening: it is a file's first."""
    own = [f.strip(" \t\r") for f in own]
    if opening:
        own[0] = own[0].removeprefix("\ufeff").strip(" \t\r")
    if odd or (quoted and any('"' in f and not _QUOTED.fullmatch(f) for f in own)):
        return "quoting", None, None
    if len(own) != len(layout.fields):
        return "column_count", None, None
    if quoted:
        own = [f[1:-1].replace('""', '"').strip(" \t\r") if f.startswith('"') else f for f in own]
    instant = _instant(layout, own)
    if instant is None:
        return "bad_datetime", None, None
    values = [own[layout.fields.index(f)] for f in layout.numbers]
    if not all(_NUMBER.fullmatch(v) or (not v and f in layout.empty) for v, f in zip(values, layout.numbers)):
        return "bad_value", None, None
    return None, instant, [float(v) if v else None for v in values]


def _digits(texts: pa.Array, places: tuple[int, ...]) -> np.ndarray:
    """The number that the digits at `places` of each text make; the texts have them all."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)[:-1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    out = np.zeros(len(texts), np.int64)
    for p in places:
        out = out * 10 + (data[offsets + p] - 48)
    return out


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(days since 1970, is it a real date)."""
    inside = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    month = (np.where(inside, y, 1970) - 1970) * 12 + np.where(inside, m, 1) - 1
    first = month.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    after = (month + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    return first + d - 1, inside & (first + d - 1 < after)


def _matches(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, f"^(?:{pattern})$").to_numpy(zero_copy_only=False)


def _instants(layout: Layout, fields: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(microseconds since 1970 UTC, is it a real time) of the lines' times, as `_instant` of each."""
    n = len(fields[0])
    at, good = np.zeros(n, np.int64), np.zeros(n, bool)
    if layout.when == "split":
        own = np.flatnonzero(_matches(fields[0], _DAY.pattern) & _matches(fields[1], _TIME.pattern))
        day, time = (f.take(pa.array(own)) for f in fields[:2])
        days, real = _days(_digits(day, (0, 1, 2, 3)), _digits(day, (5, 6)), _digits(day, (8, 9)))
        h, m, s = _digits(time, (0, 1)), _digits(time, (3, 4)), 0
        zone = 0
    else:
        own = np.flatnonzero(_matches(fields[0], _DAY_TIME.pattern))
        text = fields[0].take(pa.array(own))
        days, real = _days(_digits(text, (0, 1, 2, 3)), _digits(text, (5, 6)), _digits(text, (8, 9)))
        h, m, s = (_digits(text, p) for p in ((11, 12), (14, 15), (17, 18)))
        zone = np.zeros(len(own), np.int64)
        away = np.flatnonzero(pc.binary_length(text).to_numpy(zero_copy_only=False) > 20)
        if len(away):
            far = text.take(pa.array(away))
            zh, zm = _digits(far, (20, 21)), _digits(far, (23, 24))
            zone[away] = np.where(pc.equal(pc.binary_slice(far.cast(pa.binary()), 19, 20), b"+").to_numpy(zero_copy_only=False), 1, -1) * (zh * 3600 + zm * 60)
            real[away] &= (zh < 24) & (zm < 60)
    real &= (h < 24) & (m < 60) & (s < 60)
    at[own] = (days * 86400 + h * 3600 + m * 60 + s - zone) * 1_000_000
    good[own] = real
    return at, good


def _column(texts: pa.Array, may_be_empty: bool) -> tuple[np.ndarray, np.ndarray]:
    """(values with NaN for none, is it a number or may it be empty)."""
    good = _matches(texts, _NUMBER.pattern)
    plain = pc.if_else(pa.array(good), texts, pa.scalar(None, pa.string()))
    # Arrow reads no sign + and fails on numbers out of range: those are left to Python.
    odd = good & pc.match_substring_regex(texts, "^[+]|[eE]|.{300}").to_numpy(zero_copy_only=False)
    value = pc.cast(pc.if_else(pa.array(odd), pa.scalar(None, pa.string()), plain), pa.float64()).to_numpy(zero_copy_only=False).copy()
    for i in np.flatnonzero(odd).tolist():
        value[i] = float(texts[i].as_py())
    if may_be_empty:
        good = good | (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0)
    return value, good


#: Reasons by number; 0 is none, _HEADER no data line.
_CODES = {None: 0} | {r: i for i, r in enumerate(REASONS, 1)}
_HEADER = 9


def _batch(layout: Layout, delim: str, numbers: np.ndarray, lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of the reason, microseconds, values in the order of layout.numbers, NaN for none) of each line."""
    cut = _cut(lines, delim)
    n, width = len(lines), len(layout.fields)
    code, at, values = np.zeros(n, np.int8), np.zeros(n, np.int64), np.full((n, len(layout.numbers)), np.nan)
    header = (numbers == 1) & layout.headed
    code[header] = _HEADER
    single = ~header & (cut.quoted | (numbers == 1))
    buffer = cut.raw.tobytes() if single.any() else b""
    for i in np.flatnonzero(single).tolist():
        own = [buffer[a:b].decode("utf-8") for a, b in zip(cut.begins[cut.first[i] : cut.last[i]].tolist(), cut.stops[cut.first[i] : cut.last[i]].tolist())]
        reason, when, found = _one(layout, own, numbers[i] == 1, bool(cut.odd[i]), bool(cut.quoted[i]))
        code[i] = _CODES[reason]
        if found is not None:
            at[i], values[i] = when, [np.nan if v is None else v for v in found]
    plain = ~header & ~single
    code[plain & (cut.last - cut.first != width)] = _CODES["column_count"]
    whole = np.flatnonzero(plain & (cut.last - cut.first == width))
    if len(whole):
        # All fields as one array: each with the mark after it, which becomes a blank and is trimmed with the others.
        raw = cut.raw.copy()
        raw[cut.stops] = 32
        offsets = np.append(cut.begins, len(raw)).astype(np.int32)
        every = pc.utf8_trim(pa.StringArray.from_buffers(len(cut.begins), pa.py_buffer(offsets), pa.py_buffer(raw)), " \t\r")
        fields = [every.take(pa.array(cut.first[whole] + k)) for k in range(width)]
        when, timed = _instants(layout, fields)
        good = np.ones(len(whole), bool)
        for j, f in enumerate(layout.numbers):
            values[whole, j], fits = _column(fields[layout.fields.index(f)], f in layout.empty)
            good &= fits
        code[whole] = np.where(~timed, _CODES["bad_datetime"], np.where(~good, _CODES["bad_value"], 0))
        at[whole] = when
    values[code > 0] = np.nan
    return code, at, values


def parsed(lines: DataFrame) -> DataFrame:
    """One row for each data line: line_id, file_name, layout, reason (null for a line that loads), datetime (UTC), the
    numbers of its layout (open, high, low, close, volume, dividends, stock_splits).

    lines: line_id, file_name, line_no, layout, delim, line; other columns are ignored. The header of a headed layout
    (line 1) gives no row. Of several faults the first in the order of REASONS is the reason. Blanks are spaces and
    tabs. A null or empty line has one empty field, so its reason is `column_count`; so has a line of an unknown or
    null layout. A null or empty delim is a comma; a delim of several bytes never occurs. Infinite values can't occur
    but by overflow of a number, which then loads as infinity. Lines are read on their own: no order is needed, and
    nothing is shuffled.
    """
    numbers = ("open", "high", "low", "close", "volume", "dividends", "stock_splits")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nos = pc.fill_null(batch.column(2).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
            lines = pc.fill_null(batch.column(5), "")
            groups: dict[tuple[str | None, str], list[int]] = {}
            for i, k in enumerate(zip(batch.column(3).to_pylist(), (d or "," for d in batch.column(4).to_pylist()))):
                groups.setdefault(k, []).append(i)
            code = np.full(batch.num_rows, _CODES["column_count"], np.int8)
            at = np.zeros(batch.num_rows, np.int64)
            columns = np.full((batch.num_rows, len(numbers)), np.nan)
            for (name, delim), own in groups.items():
                layout = LAYOUTS.get(name)
                if layout is None or len(delim.encode()) != 1:
                    continue
                code[own], at[own], values = _batch(layout, delim, nos[own], lines.take(pa.array(own)))
                columns[np.ix_(own, [numbers.index(f) for f in layout.numbers])] = values
            kept = np.flatnonzero(code != _HEADER)
            loads = code[kept] == 0
            own_rows = batch.take(pa.array(kept))
            reasons = pa.DictionaryArray.from_arrays(pa.array(np.maximum(code[kept] - 1, 0), pa.int8(), mask=loads), pa.array(REASONS)).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    own_rows.column(0).cast(pa.int64()),
                    own_rows.column(1).cast(pa.string()),
                    own_rows.column(3).cast(pa.string()),
                    reasons,
                    pa.array(at[kept], pa.int64(), mask=~loads).cast(pa.timestamp("us")),
                    *(pa.array(columns[kept, k], pa.float64(), from_pandas=True) for k in range(len(numbers))),
                ],
                ["line_id", "file_name", "layout", "reason", "datetime", *numbers],
            )

    schema = "line_id long, file_name string, layout string, reason string, datetime timestamp_ntz, " + ", ".join(f"{n} double" for n in numbers)
    return lines.select("line_id", "file_name", "line_no", "layout", "delim", "line").mapInArrow(rows, schema)
