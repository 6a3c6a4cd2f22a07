"""Times written in many ways and zones, as one instant in UTC each (problem 3).

Every value gets all its interpretations as an array. Where more than one is left, the one is chosen by Viterbi's
algorithm over the record order of its source: switches of the form and jumps back in time cost. Order is cut into
blocks; a block is first reduced to the least costs between its first and last record's interpretations, the blocks of
a source are then chained, and each block is last walked back on its own. That is exact, and no task holds a source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.timetext import interpretations
from barloom.sources.tables import written

SWITCH, BACK = 1.0, 2.0


def candidates(stamps: DataFrame, source: str, order: str, both: bool = False) -> DataFrame:
    """(id, source, seq, forms, instants): arrays of equal length with all interpretations of each row's text.

    stamps: the columns `order` (a bigint, unique: the id and the record order), `source`, tz, day_order, date, time,
    datetime. The text is datetime, or date and time with a blank between if datetime is null, or date if time is null
    too. Other columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sources, *rest = (c.to_pylist() for c in batch.columns)
            forms, instants, ends = [], [], [0]
            for tz, day_order, day, time, whole in zip(*rest):
                text = whole if whole is not None or day is None else day if time is None else f"{day.strip()} {time.strip()}"
                found = interpretations(text, tz, day_order, both)
                for form, instant in found:
                    forms.append(form)
                    instants.append(instant)
                ends.append(len(forms))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(flat, kind)) for flat, kind in ((forms, pa.string()), (instants, pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sources, pa.string()), *lists],
                ["id", "source", "forms", "instants"],
            )

    narrow = stamps.select(F.col(f"`{order}`").cast("bigint"), F.col(f"`{source}`").cast("string"), "tz", "day_order", "date", "time", "datetime")
    return narrow.mapInArrow(rows, "id long, source string, forms array<string>, instants array<long>")


def _step(costs: list[float], f0, t0, f1, t1) -> tuple[list[float], list[int]]:
    """Least costs of each next interpretation, and the place of the one before; ties take the first."""
    if len(f0) == 1 == len(f1):
        return [costs[0] + (SWITCH if f0[0] != f1[0] else 0) + (BACK if t0[0] > t1[0] else 0)], [0]
    out, back = [], []
    for f, t in zip(f1, t1):
        best, at = float("inf"), 0
        for i, (cost, g, u) in enumerate(zip(costs, f0, t0)):
            cost += (SWITCH if g != f else 0) + (BACK if u > t else 0)
            if cost < best:
                best, at = cost, i
        out.append(best)
        back.append(at)
    return out, back


def _sorted(group: pa.Table, by: str) -> pa.Table:
    return group.take(pc.sort_indices(group[by]))


def _block(group: pa.Table) -> pa.Table:
    """One row: the first and last record's interpretations and the least costs between them."""
    group = _sorted(group, "id")
    forms, times = group["forms"].to_pylist(), group["instants"].to_pylist()
    matrix = []
    for i in range(len(forms[0])):
        costs = [0.0 if k == i else float("inf") for k in range(len(forms[0]))]
        for k in range(1, len(forms)):
            costs, _ = _step(costs, forms[k - 1], times[k - 1], forms[k], times[k])
        matrix += costs
    row = (group["source"][0].as_py(), group["block"][0].as_py(), forms[0], times[0], forms[-1], times[-1], matrix)
    return pa.table([pa.array([v], k) for v, k in zip(row, _BLOCK.types)], schema=_BLOCK)


def _chain(group: pa.Table) -> pa.Table:
    """The places of each block's first and last choice on the source's best path."""
    rows = _sorted(group, "block").to_pylist()
    backs, costs = [], []
    for k, r in enumerate(rows):
        n0, n1 = len(r["f0"]), len(r["f1"])
        entry, back0 = ([0.0] * n0, None) if k == 0 else _step(costs, rows[k - 1]["f1"], rows[k - 1]["t1"], r["f0"], r["t0"])
        inside = [min(range(n0), key=lambda i, j=j: entry[i] + r["cost"][i * n1 + j]) for j in range(n1)]
        costs = [entry[i] + r["cost"][i * n1 + j] for j, i in enumerate(inside)]
        backs.append((back0, inside))
    last = min(range(len(costs)), key=costs.__getitem__)
    out = []
    for r, (back0, inside) in zip(reversed(rows), reversed(backs)):
        first = inside[last]
        out.append((r["source"], r["block"], first, last))
        last = back0[first] if back0 is not None else 0
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), _CHAIN.types)], schema=_CHAIN)


def _walk(group: pa.Table) -> pa.Table:
    """The choice of each record of a block, between given first and last choices."""
    group = _sorted(group, "id")
    forms, times = group["forms"].to_pylist(), group["instants"].to_pylist()
    first, last = group["first"][0].as_py(), group["last"][0].as_py()
    costs, backs = [0.0 if k == first else float("inf") for k in range(len(forms[0]))], []
    for k in range(1, len(forms)):
        costs, back = _step(costs, forms[k - 1], times[k - 1], forms[k], times[k])
        backs.append(back)
    places = [last]
    for back in reversed(backs):
        places.append(back[places[-1]])
    places.reverse()
    columns = (group["id"].combine_chunks(), pa.array([t[p] for t, p in zip(times, places)], pa.int64()), pa.array([f[p] for f, p in zip(forms, places)], pa.string()))
    return pa.table(list(columns), schema=_WALK)


_TEXTS, _TIMES = pa.list_(pa.string()), pa.list_(pa.int64())
_BLOCK = pa.schema([("source", pa.string()), ("block", pa.int64()), ("f0", _TEXTS), ("t0", _TIMES), ("f1", _TEXTS), ("t1", _TIMES), ("cost", pa.list_(pa.float64()))])
_CHAIN = pa.schema([("source", pa.string()), ("block", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
_WALK = pa.schema([("id", pa.int64()), ("utc_us", pa.int64()), ("form", pa.string())])


def normalised(stamps: DataFrame, source: str, order: str, both: bool = False, block_rows: int = 4096) -> DataFrame:
    """(id, utc_us, form): the chosen instant of each row that means a time; see `candidates` for the input.

    Rows without an interpretation give no row and are no step of the path. Ties between paths take the first
    interpretation in order of form and instant. Null sources form one source. Blocks of one source in which every
    value has one interpretation need no path. An empty table gives no rows.
    """
    found = written(candidates(stamps, source, order, both).where(F.size("instants") > 0), "candidates")
    found = found.withColumn("block", F.floor(F.col("id") / block_rows))
    one = found.groupBy("source", "block").agg((F.max(F.size("instants")) > 1).alias("open"))
    named = [F.col("source").alias("_s"), F.col("block").alias("_b")]
    same = F.expr("source <=> _s and block <=> _b")
    # A block is on the path if it is open, or next to an open one of its source: its end fixes the neighbour's.
    near = F.expr("open or coalesce(lag(open) over (partition by source order by block), false) or coalesce(lead(open) over (partition by source order by block), false)")
    state = one.withColumn("near", near)
    on_path = found.join(state.where("near").select(*named), same, "left_semi")
    ends = on_path.groupBy("source", "block").applyInArrow(_block, "source string, block long, f0 array<string>, t0 array<long>, f1 array<string>, t1 array<long>, cost array<double>")
    chosen = ends.groupBy("source").applyInArrow(_chain, "source string, block long, first long, last long")
    chosen = chosen.select(*named, "first", "last")
    walked = on_path.join(chosen, same).select("id", "source", "block", "forms", "instants", "first", "last").groupBy("source", "block").applyInArrow(_walk, "id long, utc_us long, form string")
    alone = found.join(state.where("near").select(*named), same, "left_anti").select("id", F.col("instants")[0].alias("utc_us"), F.col("forms")[0].alias("form"))
    return alone.unionByName(walked)
