"""Differences between two copies of a keyed table, field by field (problem 7).

Both sides are unioned, reduced to the row in force of each key and side in one shuffle by key, unpivoted to
(key, field, value) with a count of +1 or -1, and grouped: what doesn't cancel is a difference. The second grouping
finds its rows already placed by key, so it moves nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ONLY_A, ONLY_B = "only_a", "only_b"


_WHOLE = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def _exact(kinds: Sequence[T.DataType]) -> tuple[int, int] | None:
    """Digits before and after the point that hold both kinds exactly; None if one is no whole number or decimal."""
    parts = []
    for k in kinds:
        if isinstance(k, T.DecimalType):
            parts.append((k.precision - k.scale, k.scale))
        elif type(k) in _WHOLE:
            parts.append((_WHOLE[type(k)], 0))
        else:
            return None
    return max(a for a, _ in parts), max(b for _, b in parts)


def differences(
    a: DataFrame, b: DataFrame, key: str, fields: Sequence[str], version: str | None = None, tolerance: float = 0.0
) -> DataFrame:
    """(key, difference): `only_a`, `only_b`, or the name of a field whose values differ, once each.

    The row in force of a key is the one with the greatest `version`; among equal versions (or without a version) the
    greatest by its fields in their order, nulls lowest, so that repeated rows and ties give one defined row. Fields
    that are numbers on both sides differ when they are more than `tolerance` apart; NaN is a value that equals only
    NaN. Whole numbers and decimals are compared exactly, unless the other side is floating (or 38 digits don't hold
    both); then both are doubles. Other fields differ when unequal as strings. Null differs from a value, not from null. A null key is a key
    of its own. Columns not named are ignored, whatever their names; an empty side makes every key of the other one
    `only_`; two empty sides give no row.
    """
    types = [{f.name: f.dataType for f in df.schema.fields} for df in (a, b)]
    sizes = {f: size for f in fields if (size := _exact([t[f] for t in types]))}
    after = max((b for _, b in sizes.values()), default=0)
    sizes = {f: size for f, size in sizes.items() if size[0] + after <= 38}
    exact_kind = f"decimal(38,{after})" if after else "bigint"
    exact = {f: f in sizes for f in fields}
    number = {f: not exact[f] and all(isinstance(t[f], (T.NumericType, T.BooleanType)) for t in types) for f in fields}

    def side(df: DataFrame, sign: int):
        cells = [
            F.col(f"`{f}`").cast(exact_kind if exact[f] else "double" if number[f] else "string").alias(f"v{i}")
            for i, f in enumerate(fields)
        ]
        order = F.col(f"`{version}`").cast("timestamp" if isinstance(types[0][version], (T.TimestampType, T.TimestampNTZType)) else types[0][version]) if version else F.lit(0)
        return df.select(F.col(f"`{key}`").alias("k"), F.lit(sign).alias("sign"), F.struct(order.alias("version"), *cells).alias("row"))

    forced = (
        side(a, 1)
        .unionByName(side(b, -1))
        .groupBy("k")
        .agg(
            F.max(F.when(F.col("sign") == 1, F.col("row"))).alias("row_a"),
            F.max(F.when(F.col("sign") == -1, F.col("row"))).alias("row_b"),
        )
    )

    def cells(row: str, sign: int):
        return [
            F.when(
                F.col(row).isNotNull(),
                F.struct(
                    F.lit(i).alias("field"),
                    F.lit(sign).alias("sign"),
                    (F.col(f"{row}.v{i}") if number[f] else F.lit(None).cast("double")).alias("num"),
                    (F.lit(None).cast("string") if number[f] or exact[f] else F.col(f"{row}.v{i}")).alias("txt"),
                    *([(F.col(f"{row}.v{i}") if exact[f] else F.lit(None).cast(exact_kind)).alias("whole")] if sizes else []),
                ),
            )
            for i, f in enumerate(fields)
        ]

    each = forced.select("k", F.explode(F.array_compact(F.array(*cells("row_a", 1), *cells("row_b", -1)))).alias("c"))
    is_a, num, txt = F.col("c.sign") == 1, F.col("c.num"), F.col("c.txt")
    odd = F.isnan(num)
    whole = F.col("c.whole") if sizes else F.lit(None)
    cell = each.groupBy("k", F.col("c.field").alias("field")).agg(
        F.count(F.when(is_a, 1)).alias("in_a"),
        F.count(F.when(~is_a, 1)).alias("in_b"),
        F.sum(F.when(num.isNotNull() | txt.isNotNull() | whole.isNotNull(), F.col("c.sign")).otherwise(0)).alias("balance"),
        F.sum(F.when(odd, F.col("c.sign")).otherwise(0)).alias("odd"),
        F.sum(F.when(~odd, num * F.col("c.sign"))).alias("apart"),
        F.min(txt).alias("low"),
        F.max(txt).alias("high"),
        *([F.min(whole).alias("least"), F.max(whole).alias("most")] if sizes else []),
    )
    name = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("field") + 1)
    differs = (F.col("balance") != 0) | (F.col("odd") != 0) | (F.abs(F.col("apart")) > tolerance) | (F.col("low") != F.col("high"))
    if sizes:
        most, least = F.col("most").cast(f"decimal(38,{after})"), F.col("least").cast(f"decimal(38,{after})")
        differs = F.coalesce(differs, F.lit(False)) | ((most != least) & F.coalesce(F.try_subtract(most, least) > F.lit(tolerance), F.lit(True)))
    difference = (
        F.when(F.col("in_b") == 0, F.when(F.col("field") == 0, F.lit(ONLY_A)))
        .when(F.col("in_a") == 0, F.when(F.col("field") == 0, F.lit(ONLY_B)))
        .when(F.coalesce(differs, F.lit(False)), name)
    )
    return cell.select(F.col("k").alias(key), difference.alias("difference")).where("difference is not null")
