"""Fields that drift between files: one consistent table, and every change from file to file (problem 6).

Each record is a JSON object. A union of tagged types is inferred for each file and name by fusing the kinds of all
its values, first inside each batch, then over the cluster; the one table keeps each kind as a branch beside the
canonical value. `alternatives` does the same for every path inside objects and arrays.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.tables import written

#: Digits before the point up to which a number is a time in a unit, and that unit in microseconds.
EPOCH_UNITS = ((11, 1_000_000), (14, 1_000), (17, 1))
KINDS = ("string", "double", "long", "boolean", "object", "array", "null")


class _Fraction(str):
    """A number written with a point or exponent, as written."""


class _Whole(str):
    """A number written without one, as written."""


def _kind(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, _Fraction):
        return "double"
    if isinstance(value, _Whole):
        return "long"
    if isinstance(value, str):
        return "string"
    if isinstance(value, bool):
        return "boolean"
    return "array" if isinstance(value, list) and not isinstance(value, _Object) else "object"


class _Object(list):
    """The (name, value) pairs of an object, repeated names included."""


_read = json.JSONDecoder(object_pairs_hook=_Object, parse_float=_Fraction, parse_int=_Whole, parse_constant=_Fraction).decode


def _json(value: object) -> str:
    """A value as JSON text, numbers as written. Without recursion, as values may be nested deeper than Python's calls."""
    out: list[str] = []
    stack: list = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, tuple):  # a piece of text
            out.append(v[0])
        elif isinstance(v, (_Fraction, _Whole)):
            out.append(str(v))
        elif isinstance(v, list):
            whole = isinstance(v, _Object)
            parts: list = [("{" if whole else "[",)]
            for i, e in enumerate(v):
                parts += [(", ",)] * (i > 0) + ([(json.dumps(e[0]) + ": ",), e[1]] if whole else [e])
            stack.extend(reversed([*parts, ("}" if whole else "]",)]))
        else:
            out.append(json.dumps(v))
    return "".join(out)


def _text(value: object) -> str | None:
    """What rest keeps: a text as it is, all else as JSON text; null for null."""
    return None if value is None else str(value) if isinstance(value, str) else _json(value)


def _paths(pairs: _Object) -> Iterator[tuple[str, str, str]]:
    """(name, path below it, kind) of every value of a record; .name for a member, [] for the elements of an array."""
    stack = [(name.strip().lower(), "", value) for name, value in reversed(pairs)]
    while stack:
        name, path, value = stack.pop()
        yield name, path, _kind(value)
        if isinstance(value, _Object):
            for k, v in value:
                k = k.strip().lower()
                stack.append((name, f"{path}.{json.dumps(k) if set(k) & set('.[]') else k}", v))
        elif isinstance(value, list):
            stack.extend((name, f"{path}[]", v) for v in value)


def _pairs(text: str | None) -> _Object | None:
    if text is None:
        return None
    try:
        pairs = _read(text)
    except (ValueError, RecursionError):
        return None
    return pairs if isinstance(pairs, _Object) else None


_read_plain = json.JSONDecoder(object_pairs_hook=_Object).decode
_PLAIN_KINDS = {str: "string", float: "double", int: "long", bool: "boolean", _Object: "object", list: "array", type(None): "null"}


def _shape(text: str | None) -> tuple[tuple[str, str], ...]:
    """The (name as written, kind) pairs of a record; none for what isn't a JSON object."""
    if text is None:
        return ()
    try:
        pairs = _read_plain(text)
    except (ValueError, RecursionError):  # also whole numbers of thousands of digits
        return tuple((name, _kind(value)) for name, value in _pairs(text) or ())
    return tuple((name, _PLAIN_KINDS[type(value)]) for name, value in pairs) if isinstance(pairs, _Object) else ()


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files, providers, times, texts = (c.to_pylist() for c in batch.columns)
        shapes = Counter(zip(files, providers, times, map(_shape, texts)))
        seen: Counter = Counter()
        for (file, provider, at, shape), n in shapes.items():
            seen[(file, provider, at, None, None)] += n
            for name, kind in shape:
                seen[(file, provider, at, name.strip().lower(), kind)] += n
        cols = list(zip(*seen)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(cols[0], pa.int64()),
                pa.array(cols[1], pa.string()),
                pa.array(cols[2], pa.int64()),
                pa.array(cols[3], pa.string()),
                pa.array(cols[4], pa.string()),
                pa.array(list(seen.values()), pa.int64()),
            ],
            ["file_no", "provider", "at", "name", "kind", "n"],
        )


def _fields(aliases: DataFrame) -> DataFrame:
    """(name, known): the field of each alias; of an alias named twice the greatest."""
    named = aliases.select(F.trim(F.lower("alias")).alias("name"), F.col("field").alias("known")).where("name is not null")
    return named.groupBy("name").agg(F.max("known").alias("known"))


def tagged_types(records: DataFrame) -> DataFrame:
    """(file_no, provider, at, name, kind, n): the kinds of value each name of each file holds, fused over its records.

    records: file_no, provider, loaded_at, record_json. Names are trimmed and in lower case. One row with a null name
    counts the records of a file, so that a file of records without keys, or of texts that aren't a JSON object
    (these hold no field), is still a file. A name repeated in a record counts each time.
    """
    narrow = records.select("file_no", "provider", F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("at"), "record_json")
    schema = "file_no long, provider string, at long, name string, kind string, n long"
    return narrow.mapInArrow(_kinds, schema).groupBy("file_no", "provider", "at", "name", "kind").agg(F.sum("n").alias("n"))


def changes(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """(file_no, field, change_kind): each file against its provider's file before it, by loaded_at, then file_no.

    aliases: (alias, field), alias in lower case; another name is its own field. change_kind is `added`, `removed`,
    `renamed` (same field, another set of names) or `type_changed`. A file's type of a field is the first of string
    (also for booleans, objects and arrays), double, long that any value that isn't null has; a file with nulls only
    keeps the type the field had last. A provider's first file has no change. Null providers form one provider. The fused
    types, a few rows a file, are written to the shared folder once, as they are read for files and for fields.
    """
    fused = written(tagged_types(records), "types")
    order = Window.partitionBy("provider").orderBy("at", "file_no")
    files = (
        fused.where("name is null")
        .groupBy("provider", "file_no")
        .agg(F.min("at").alias("at"))
        .select(
            F.col("provider").alias("of_provider"),
            F.col("file_no").alias("of_file"),
            F.row_number().over(order).alias("seq"),
            F.lead("file_no").over(order).alias("next_file"),
        )
    )
    known = _fields(aliases)
    has = lambda *kinds: F.max(F.col("kind").isin(*kinds))
    fields = (
        fused.where("name is not null")
        .join(known, "name", "left")
        .groupBy("provider", "file_no", F.coalesce("known", "name").alias("field"))
        .agg(
            F.sort_array(F.collect_set("name")).alias("names"),
            F.when(has("string", "boolean", "object", "array"), "string").when(has("double"), "double").when(has("long"), "long").alias("own_type"),
        )
        .join(files, F.expr("provider <=> of_provider and file_no <=> of_file"))
    )
    w = Window.partitionBy("provider", "field").orderBy("seq")
    typed = fields.withColumn("type", F.last("own_type", ignorenulls=True).over(w))
    seen = typed.withColumns({
        "before": F.lag("seq").over(w),
        "after": F.lead("seq").over(w),
        "names_before": F.lag("names").over(w),
        "type_before": F.lag("type").over(w),
    })
    follows = F.coalesce(F.col("before") == F.col("seq") - 1, F.lit(False))
    here = lambda test, kind: F.when(test, F.struct(F.col("file_no").alias("file_no"), F.lit(kind).alias("change_kind")))
    gone = F.col("next_file").isNotNull() & ~F.coalesce(F.col("after") == F.col("seq") + 1, F.lit(False))
    found = F.array_compact(
        F.array(
            here((F.col("seq") > 1) & ~follows, "added"),
            here(follows & (F.col("names") != F.col("names_before")), "renamed"),
            here(follows & (F.col("type") != F.col("type_before")), "type_changed"),
            F.when(gone, F.struct(F.col("next_file").alias("file_no"), F.lit("removed").alias("change_kind"))),
        )
    )
    return seen.select("field", F.explode(found).alias("c")).select("c.file_no", "field", "c.change_kind")


def _path_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict = {}
        for file, provider, at, text in zip(*(c.to_pylist() for c in batch.columns)):
            seen[file, provider, at, None, None, None] = None
            seen.update(dict.fromkeys((file, provider, at, *found) for found in _paths(_pairs(text) or _Object())))
        cols = list(zip(*seen)) or [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["file_no", "provider", "at", "name", "below", "kind"])


def alternatives(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """(file_no, path, kind): each kind of value that a path holds in a file for the first time among its provider's
    files, by loaded_at, then file_no; nothing for a provider's first file. path: the field, then .name for members of
    objects and [] for elements of arrays. kind: one of KINDS."""
    narrow = records.select("file_no", "provider", F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("at"), "record_json")
    fused = written(narrow.mapInArrow(_path_kinds, "file_no long, provider string, at long, name string, below string, kind string").distinct(), "paths")
    order = Window.partitionBy("provider").orderBy("at", "file_no")
    files = fused.where("name is null").groupBy("provider", "file_no").agg(F.min("at").alias("at"))
    files = files.select(F.col("provider").alias("of_provider"), F.col("file_no").alias("of_file"), F.row_number().over(order).alias("seq"))
    known = _fields(aliases)
    path = F.concat(F.coalesce("known", "name"), "below").alias("path")
    seen = fused.where("name is not null").join(known, "name", "left").select("provider", "file_no", path, "kind").join(files, F.expr("provider <=> of_provider and file_no <=> of_file"))
    first = seen.groupBy("provider", "path", "kind").agg(F.min(F.struct("seq", "file_no")).alias("f"))
    return first.where("f.seq > 1").select("f.file_no", "path", "kind")


def _number(value: object) -> float | None:
    if isinstance(value, str):
        try:
            return None if "_" in value else float(value)
        except ValueError:
            return None
    return float(value) if isinstance(value, bool) else None


_BRANCHES = pa.struct([("string", pa.string()), ("double", pa.float64()), ("long", pa.int64()), ("other", pa.string())])


def _branch(value: object, kind: str | None) -> dict | None:
    """A value in the branch of its kind; null for null."""
    if value is None:
        return None
    if kind == "string":
        return {"string": str(value)}
    if kind == "double":
        return {"double": float(value)}
    if kind == "long" and len(value) < 20 and -(2**63) <= int(value) < 2**63:
        return {"long": int(value)}
    return {"other": _json(value)}


def consolidated(records: DataFrame, aliases: DataFrame, numbers: tuple[str, ...], times: tuple[str, ...]) -> DataFrame:
    """One table of all records: record_id, file_no, each field of `numbers` as double, each of `times` as the text of
    a timestamp in UTC, <field>_as with the kind it was written in (null where the key is absent), <field>_branch with the
    value as written in the branch of its kind (string, double, long, or other: JSON text, also of whole numbers beyond
    64 bits), and rest, a map of the other fields to their text, if they are texts, or else their JSON text.

    A value that doesn't convert is null, with its text kept in rest under the field's name. Numbers in `times` are times
    since 1970, in seconds, milliseconds or microseconds by their digits before the point (EPOCH_UNITS). Parts of a second
    are kept to the microsecond. A field under several names in one record takes the first value that isn't null. A text
    that isn't a JSON object gives a row of nulls. `aliases` is collected to the driver for this, after a check that it
    has at most 10,000 rows.
    """
    pairs = aliases.select(F.trim(F.lower("alias")), "field").limit(10_001).collect()
    if len(pairs) > 10_000:
        raise ValueError("aliases has more than 10,000 rows")
    known = {a: f for a, f in sorted(tuple(p) for p in pairs if p[0] is not None)}
    wanted = (*numbers, *times)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, files, texts = (c.to_pylist() for c in batch.columns)
            out: dict[str, list] = {f: [] for f in wanted} | {f"{f}_as": [] for f in wanted} | {f"{f}_branch": [] for f in wanted} | {"rest": []}
            for text in texts:
                values: dict[str, object] = {}
                for name, value in _pairs(text) or ():
                    name = name.strip().lower()
                    field = known.get(name, name)
                    if values.get(field) is None:
                        values[field] = value
                rest = {}
                for f in wanted:
                    value = values.get(f)
                    kind = _kind(value) if f in values else None
                    if f in numbers:
                        plain = _number(value)
                    else:
                        plain = None if kind in (None, "null", "object", "array", "boolean") else str(value).strip()
                    if value is not None and (plain is None or f in times):
                        rest[f] = _text(value)
                    out[f].append(plain)
                    out[f"{f}_as"].append(kind)
                    out[f"{f}_branch"].append(_branch(value, kind))
                rest |= {k: _text(v) for k, v in values.items() if k not in wanted}
                out["rest"].append(list(rest.items()))
            kinds = [pa.float64() if f in numbers else pa.string() for f in wanted]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(files, pa.int64())]
                + [pa.array(out[f], k) for f, k in zip(wanted, kinds)]
                + [pa.array(out[f"{f}_as"], pa.string()) for f in wanted]
                + [pa.array(out[f"{f}_branch"], _BRANCHES) for f in wanted]
                + [pa.array(out["rest"], pa.map_(pa.string(), pa.string()))],
                ["record_id", "file_no", *wanted, *(f"{f}_as" for f in wanted), *(f"{f}_branch" for f in wanted), "rest"],
            )

    schema = ", ".join(
        ["record_id long, file_no long"]
        + [f"`{f}` {'double' if f in numbers else 'string'}" for f in wanted]
        + [f"`{f}_as` string" for f in wanted]
        + [f"`{f}_branch` struct<string: string, double: double, long: bigint, other: string>" for f in wanted]
        + ["rest map<string, string>"]
    )
    table = records.select("record_id", "file_no", "record_json").mapInArrow(rows, schema)
    for f in times:
        size = F.col(f).try_cast("decimal(25,6)")
        micros = F.lit(None)
        for digits, unit in reversed(EPOCH_UNITS):
            micros = F.when(F.abs(size) < 10**digits, (size * unit).cast("bigint")).otherwise(micros)
        parsed = F.when(F.col(f"{f}_as").isin("long", "double"), F.timestamp_micros(micros)).otherwise(F.col(f).try_cast("timestamp"))
        table = table.withColumn(f, parsed.cast("string"))
        table = table.withColumn("rest", F.when(F.col(f).isNull(), F.col("rest")).otherwise(F.map_filter("rest", lambda k, _: k != f)))
    return table
