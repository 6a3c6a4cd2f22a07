"""Sequential operators: state carried along each series in order, a batch at a time.

Rows are placed by key and sorted by Spark, which spills; a Python worker then sees each series as a run of batches and
keeps only its state. No group is collected, whatever its length. A series is one task, as each state needs the last;
where an operator only looks back a bounded number of rows, `stretched` cuts the series as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Step = Callable[[dict[str, np.ndarray], dict], dict[str, np.ndarray]]


def scanned(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], step: Step, outputs: Mapping[str, str]) -> DataFrame:
    """`df` with the columns `outputs` (name -> double or long) that `step` makes.

    step gets the numeric columns of a block of rows of one series, in order, as float arrays with NaN for null, and the
    series' state, a dict that is empty at its start; it returns an array for each output, NaN for null.
    """
    order = [order] if isinstance(order, str) else list(order)
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    kept = [c for c in df.columns if c not in outputs]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(n, T.LongType() if k == "long" else T.DoubleType()) for n, k in outputs.items())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for k in keys:
                codes = batch.column(names.index(k)).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(new).tolist()
            floats = {c: batch.column(names.index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in numeric}
            made: dict[str, list[np.ndarray]] = {n: [] for n in outputs}
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                key = tuple(batch.column(names.index(k))[a].as_py() for k in keys)
                if key != now:
                    now, state = key, {}
                for n, v in step({c: v[a:b] for c, v in floats.items()}, state).items():
                    made[n].append(v)
            arrays = [batch.column(names.index(c)) for c in kept]
            for n, kind in outputs.items():
                v = np.concatenate(made[n]).astype(float)
                arrays.append(pa.array(v, pa.float64(), from_pandas=True) if kind != "long" else pa.array([None if x != x else int(x) for x in v.tolist()], pa.int64()))
            yield pa.RecordBatch.from_arrays(arrays, [*kept, *outputs])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(rows, schema)


def stretched(df: DataFrame, keys: Sequence[str], order: str, rows: int, reach: int, carried: str | None = None) -> DataFrame:
    """`df` with _stretch and _own: each series cut into stretches of `rows` rows, each stretch preceded by the `reach`
    rows before it, marked by _own = false. What looks back at most `reach` rows can run by (keys, _stretch). carried: a
    column whose last value that isn't null before all these rows comes along as _seed.

    Rows are numbered by counts of coarse blocks of the order, so no task numbers a whole series: a block is a stretch
    of the order's own values, of which each series has at most a few thousand.
    """
    span = df.groupBy(*keys).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if dict(df.dtypes)[order].startswith("timestamp") else F.col(c)
    same = F.expr(" and ".join(f"`{k}` <=> `_k_{k}`" for k in keys))
    span = span.select(*[F.col(k).alias(f"_k_{k}") for k in keys], at("_lo").alias("_lo"), at("_hi").alias("_hi"))
    block = F.floor((at(order) - F.col("_lo")) * 4096.0 / (F.col("_hi") - F.col("_lo") + 1))
    placed = df.join(span, same).withColumn("_block", block).drop("_lo", "_hi", *[f"_k_{k}" for k in keys])
    counts = placed.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"), "_before")
    local = placed.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(order)))
    n = F.col("_n") + F.col("_before") - 1
    numbered = local.join(counts, same & (F.col("_block") == F.col("_b"))).withColumn("_stretch", F.floor(n / rows)).withColumn("_left", rows - n % rows)
    later = F.floor((F.lit(reach) - F.col("_left")) / rows)  # how many more stretches beyond the next the row is wanted in
    more = F.when(F.col("_left") <= reach, F.sequence(F.col("_stretch") + 1, F.col("_stretch") + 1 + later)).otherwise(F.array().cast("array<bigint>"))
    copies = F.concat(F.array("_stretch"), more)
    out = numbered.withColumn("_s", F.explode(copies)).withColumn("_own", F.col("_s") == F.col("_stretch"))
    if carried is None:
        return out.select(*df.columns, F.col("_s").alias("_stretch"), "_own")
    # Of each stretch, the rows that come before the next one's first: one row a stretch, so a window over them is small.
    part = F.when(F.col("_left") > reach, F.col("_stretch")).otherwise(F.col("_stretch") + 1 + later).alias("_p")
    last = numbered.where(F.col(carried).isNotNull()).groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], part).agg(F.max_by(carried, order).alias("_last"))
    parts = numbered.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_stretch").alias("_p")).agg(F.lit(None).cast("double").alias("_last")).unionByName(last)
    parts = parts.groupBy(*[f"_k_{k}" for k in keys], "_p").agg(F.max("_last").alias("_last"))
    seed = F.last("_last", ignorenulls=True).over(Window.partitionBy(*[f"_k_{k}" for k in keys]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    seeds = parts.withColumn("_seed", seed).drop("_last")
    out = out.drop(*[f"_k_{k}" for k in keys])
    return out.join(seeds, same & (F.col("_s") == F.col("_p")), "left").select(*df.columns, F.col("_s").alias("_stretch"), "_own", "_seed")


def folded(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], step: Callable[[dict[str, np.ndarray], dict], np.ndarray], width: int) -> DataFrame:
    """(keys, sums): for each series the sum over its blocks of the array of `width` numbers that `step` makes of each.

    step is called as in `scanned`. One row a series leaves the workers; nulls of the keys form groups of their own.
    """
    order = [order] if isinstance(order, str) else list(order)
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, total, own = None, {}, np.zeros(width), None
        done: list[tuple[list[pa.Array], np.ndarray]] = []

        def flushed() -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(done) + 1) * width, pa.int32()), pa.array(np.concatenate([v for _, v in done]), pa.float64()))
            named = [pa.concat_arrays(list(c)) for c in zip(*(k for k, _ in done))]
            done.clear()
            return pa.RecordBatch.from_arrays([*named, lists], [*keys, "sums"])

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for k in keys:
                codes = batch.column(names.index(k)).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(new).tolist()
            floats = {c: batch.column(names.index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in numeric}
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                key = tuple(batch.column(names.index(k))[a].as_py() for k in keys)
                if own is None or key != now:
                    if own is not None:
                        done.append((own, total))
                    now, state, total = key, {}, np.zeros(width)
                    own = [batch.column(names.index(k)).slice(a, 1) for k in keys]
                total = total + step({c: v[a:b] for c, v in floats.items()}, state)
            if done:
                yield flushed()
        if own is not None:
            done.append((own, total))
            yield flushed()

    # All rows of a series are in one partition and follow each other, so each series gives one row.
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(rows, schema)


def by_stretch(df: DataFrame, keys: Sequence[str], order: str, rows: int, reach: int, make: Callable[[DataFrame, tuple[str, ...]], DataFrame]) -> DataFrame:
    """make(df, keys) over stretches of each series instead of whole series, for features that look back at most `reach`
    rows: the way for a series that holds a third of all rows. make gets the keys to partition by."""
    out = make(stretched(df, keys, order, rows, reach), (*keys, "_stretch"))
    return out.where("_own").drop("_own", "_stretch")
