"""Reading one written time: every interpretation of it that is a real instant."""

from __future__ import annotations

import re
from datetime import date, datetime
from functools import cache, lru_cache
from zoneinfo import ZoneInfo

# English month names, as far as they are compared.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_DAY_0 = date(1970, 1, 1).toordinal()
_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<half>[ap]\.?m\.?))?"
_PACKED = r"(?P<h2>\d{2})(?P<mi2>\d{2})(?P<s2>\d{2})"
_ZONE = r"(?:\s*(?P<abbr>[A-Za-z]{1,5}))?(?:\s*(?P<sign>[+-])(?P<oh>\d{2})(?::?(?P<om>\d{2}))?)?"
_AFTER = rf"(?:(?:\s*T\s*|\s+)(?:{_CLOCK}|{_PACKED}){_ZONE})?"
#: The forms of a date, each with the time that may follow. Digits are ASCII.
FORMS = tuple(
    re.compile(day + _AFTER, re.ASCII | re.IGNORECASE)
    for day in (
        r"(?P<y>\d{4})(?P<sep>[-/.])(?P<mo>\d{1,2})(?P=sep)(?P<d>\d{1,2})",
        r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})",
        r"(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<c>\d{4}|\d{2})",
        r"(?P<d>\d{1,2})[- ](?P<name>[A-Za-z]{3,9})[- ](?P<y>\d{4}|\d{2})",
        r"(?P<name>[A-Za-z]{3,9})\.? (?P<d>\d{1,2}),? (?P<y>\d{4})",
    )
)
_UNITS = {10: 1_000_000, 13: 1_000, 16: 1}
_ORDERS = {"dmy": "dmy", "mdy": "mdy", "ymd": "ymd"}


@lru_cache(4096)  # names come from the data
def zone(name: str | None) -> ZoneInfo | None:
    """The named zone, UTC for null, None for a name that isn't known."""
    try:
        return ZoneInfo(name or "UTC")
    except (KeyError, ValueError, OSError):
        return None


@cache
def abbreviations(name: str | None) -> dict[str, int]:
    """Abbreviations of a zone since 1970 with their latest offsets in seconds."""
    out: dict[str, int] = {}
    if (z := zone(name)) is not None:
        for year in range(1970, 2038):
            for month in range(1, 13):
                at = datetime(year, month, 15, 12, tzinfo=z)
                out[at.tzname() or ""] = int(at.utcoffset().total_seconds())
    return out


def _local(at: datetime, name: str | None, both: bool) -> list[int]:
    """Instants of a local time, in seconds: none in a gap, the earlier (or both) of a time that occurs twice."""
    z = zone(name)
    if z is None:
        return []
    own = at.replace(tzinfo=z)
    first, second = own.utcoffset(), own.replace(fold=1).utcoffset()
    seconds = (at.toordinal() - _DAY_0) * 86400 + at.hour * 3600 + at.minute * 60 + at.second
    here = seconds - (first.days * 86400 + first.seconds)
    if first == second:
        return [here]
    if first < second:  # the clock went forward over it
        return []
    return [here, seconds - (second.days * 86400 + second.seconds)] if both else [here]


def _forms(text: str) -> range:
    """The places in FORMS of those that a text can have, by how it begins."""
    if text[:1].isalpha():
        return range(4, 5)
    if text[:4].isdigit():
        return range(0, 1) if text[4:5] in ("-", "/", ".") else range(1, 2)
    return range(2, 4)


def _dates(found: re.Match, order: str | None) -> list[tuple[str, date]]:
    known = found.re.groupindex
    if "a" in known:
        a, b, c = int(found["a"]), int(found["b"]), int(found["c"])
        full = len(found["c"]) == 4
        if order == "dmy" or order == "mdy":
            orders = [order]
        elif order == "ymd" and not full:
            orders = ["ymd"]
        else:
            orders = ["dmy", "mdy"] if full else ["dmy", "mdy", "ymd"]
        parts = []
        for o in orders:
            y, m, d = {"dmy": (c, b, a), "mdy": (c, a, b), "ymd": (a, b, c)}[o]
            parts.append((o, y if full and o != "ymd" else 2000 + y, m, d))
    elif "name" in known:
        name = found["name"][:3].lower()
        month = MONTHS.index(name) + 1 if name in MONTHS else 0
        parts = [("named", int(found["y"]) + (2000 if len(found["y"]) == 2 else 0), month, int(found["d"]))]
    else:
        parts = [("year first", int(found["y"]), int(found["mo"]), int(found["d"]))]
    out = []
    for o, y, m, d in parts:
        try:
            out.append((o, date(y, m, d)))
        except ValueError:
            pass
    return out


def interpretations(text: str | None, tz: str | None, order: str | None, both: bool = False) -> list[tuple[str, int]]:
    """Every (form, microseconds since 1970 UTC) that the text can mean, ordered and without repeats.

    A zone in the text (offset, Z, UTC, an abbreviation of tz) holds; otherwise tz does, and null is UTC. order is
    `dmy`, `mdy` or `ymd`; null leaves all orders open. both: a local time that occurs twice has both instants, else
    the earlier. Digits of a fraction beyond microseconds are cut off. No real day or time, a local time in a gap, an
    unknown zone or form: an empty list.
    """
    if text is None:
        return []
    text = text.strip()
    if text.isascii() and text.isdigit() and len(text) in _UNITS:
        return [(f"epoch {len(text)}", int(text) * _UNITS[len(text)])]
    out = set()
    for i in _forms(text):
        found = FORMS[i].fullmatch(text)
        if not found:
            continue
        h, mi, s, fraction, half, h2, mi2, s2, abbr, sign, oh, om = found.group("h", "mi", "s", "f", "half", "h2", "mi2", "s2", "abbr", "sign", "oh", "om")
        timed = h is not None or h2 is not None
        hour, minute, second = int(h or h2 or 0), int(mi or mi2 or 0), int(s or s2 or 0)
        if half:
            if not 1 <= hour <= 12:
                continue
            hour = hour % 12 + (12 if half[0] in "pP" else 0)
        if hour > 23 or minute > 59 or second > 59:
            continue
        micro = int(fraction[:6].ljust(6, "0")) if fraction else 0
        abbr, offset = (abbr or "").upper(), None
        if sign:
            if abbr not in ("", "UTC", "GMT", "Z") or int(oh) > 23 or int(om or 0) > 59:
                continue
            offset = (1 if sign == "+" else -1) * (int(oh) * 3600 + int(om or 0) * 60)
        elif abbr:
            offset = 0 if abbr in ("Z", "UTC") else abbreviations(tz).get(abbr, 0 if abbr == "GMT" else None)
            if offset is None:
                continue
        sep = found["sep"] if "sep" in FORMS[i].groupindex else ""
        kind = f"{i} {sep} {'time' if timed else 'day'} {'half' if half else ''} {'zone' if offset is not None else ''}"
        for o, day in _dates(found, order):
            plain = offset if offset is not None else 0 if tz is None or tz == "UTC" else None
            if plain is not None:
                seconds = [(day.toordinal() - _DAY_0) * 86400 + hour * 3600 + minute * 60 + second - plain]
            else:
                seconds = _local(datetime(day.year, day.month, day.day, hour, minute, second), tz, both)
            out |= {(f"{kind} {o}", x * 1_000_000 + micro) for x in seconds}
    return sorted(out)
