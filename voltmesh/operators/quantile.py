"""Exact quantiles by radix selection: a histogram of fixed size in each of four rounds, whatever the number of values."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Bits of a value that a round settles; its histogram has at most 2^BITS rows.
BITS = 16


def ordered_bits(v: Column) -> Column:
    """A long that orders as the double does: its bits, of negative values all but the sign turned round. -0.0 counts as 0.0."""
    zero = F.lit(0.0)
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(v, zero) + zero).cast("long")
    return F.when(v.isNotNull(), F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits))


def _double(key: int) -> float:
    return struct.unpack("<d", struct.pack("<q", key if key >= 0 else key ^ ((1 << 63) - 1)))[0]


def _histogram(keys: DataFrame, shift: int, prefix: int | None) -> list[tuple[int, int]]:
    """(upper bits, count) in order, among the keys whose bits above are ``prefix``."""
    some = keys if prefix is None else keys.where(F.shiftright("key", shift + BITS) == prefix)
    return sorted((r["upper"], r["n"]) for r in some.groupBy(F.shiftright("key", shift).alias("upper")).agg(F.count("*").alias("n")).collect())


def _select(keys: DataFrame, top: list[tuple[int, int]], rank: int) -> tuple[int, int, int]:
    """(key of this rank from 0, how many equal ones are before it, how many there are)."""
    found, prefix = top, None
    for shift in range(64 - BITS, -1, -BITS):
        if shift < 64 - BITS:
            found = _histogram(keys, shift, prefix)
        for upper, n in found:
            if rank < n:
                prefix = upper
                break
            rank -= n
    return prefix, rank, n


def with_quantile(df: DataFrame, q: float, column: str = "v") -> tuple[DataFrame, float | None]:
    """df, written to the shared folder, and the exact q-quantile of a double column, linear between neighbouring ranks; None without values. Nulls do not count.

    Four rounds read the keys of the written rows only; no value is gathered."""
    rows = written(df.withColumn("__key", ordered_bits(F.col(column))), "values")
    keys = rows.select(F.col("__key").alias("key")).where("key is not null")
    top = _histogram(keys, 64 - BITS, None)
    n = sum(x for _, x in top)
    rows = rows.drop("__key")
    if not n:
        return rows, None
    place = q * (n - 1)
    low, before, equal = _select(keys, top, math.floor(place))
    high = low
    if math.ceil(place) > math.floor(place) and before + 1 == equal:
        high = keys.where(F.col("key") > low).agg(F.min("key")).first()[0]
    a, b = _double(low), _double(high)
    return rows, a if a == b else a + (b - a) * (place - math.floor(place))
