"""Sharding by jump consistent hashing (operator 1, DataFrame functions only).

The published algorithm (Lamping and Veach, 2014) draws from a 64-bit linear congruential generator seeded with the key.
Spark's long arithmetic raises on overflow, so the state is kept as two 32-bit halves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

# Fixed value: the generator's multiplier, 2862933555777941757.
MULTIPLIER = 2862933555777941757
_M1, _M0 = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_M0H, _M0L, _M1H, _M1L = _M0 >> 16, _M0 & 0xFFFF, _M1 >> 16, _M1 & 0xFFFF
_LOW = 0xFFFFFFFF
#: Rows of a shard that are numbered by one sort; a shard has as many such blocks as its rows need.
BLOCK = 4096


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW))


def _times(x: Column, high: int, low: int) -> Column:
    """Low 32 bits of x (32 bits) times a 32-bit constant."""
    return _low(x * low + F.shiftleft((x * high).bitwiseAND(F.lit(0xFFFF)), 16))


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The next state of the generator: state * MULTIPLIER + 1 modulo 2^64."""
    p0, p1 = lo * _M0L, lo * _M0H
    t = p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + 1
    carry = F.shiftright(t, 32) + F.shiftright(p1, 16)
    return _low(carry + _times(hi, _M0H, _M0L) + _times(lo, _M1H, _M1L)), _low(t)


def halves(key: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(key, 32), _low(key)


def jump(key: Column, shards: int) -> Column:
    """The shard (0 to shards - 1) of a 64-bit key. A key moves into shard n only when the count grows from n to n + 1.

    Each round moves to a higher shard, so ``shards`` rounds always end the walk; about ln(shards) + 1 of them do work.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    hi, lo = halves(key)

    def go(acc: Column, _: Column) -> Column:
        nhi, nlo = _step(acc["hi"], acc["lo"])
        ahead = F.floor((acc["j"] + 1) * (F.lit(2147483648.0) / (F.shiftright(nhi, 1) + 1).cast("double"))).cast("long")
        return F.when(acc["j"] >= shards, acc).otherwise(F.struct(nhi.alias("hi"), nlo.alias("lo"), acc["j"].alias("b"), ahead.alias("j")))

    start = F.struct(hi.alias("hi"), lo.alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    inner = 64

    def block(acc: Column, _: Column) -> Column:
        return F.when(acc["j"] >= shards, acc).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(min(inner, shards))), acc, go))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(-(-shards // inner))), start, block)
    return walked["b"].cast("int")


def shard_key(df: DataFrame, key: str) -> Column:
    """An integer key as it is, any other by its 64-bit hash; null counts as 0."""
    whole = df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.coalesce(F.col(key).cast("long") if whole else F.xxhash64(key), F.lit(0).cast("long"))


def assign(df: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """df with ``shard`` and ``grown_shard`` (with one shard more), from the key alone: no shuffle, no ring table.

    A null key counts as 0; an input column named like an added one raises ValueError."""
    if both := {"shard", "grown_shard"} & set(df.columns):
        raise ValueError(f"rename these input columns first: {sorted(both)}")
    return df.withColumns({"shard": jump(shard_key(df, key), shards), "grown_shard": jump(shard_key(df, key), shards + 1)})


def number(df: DataFrame, order: list[str], shard: str = "shard", key: str = "doc_id") -> DataFrame:
    """df with ``slot``: rows of each shard numbered from 0 without gaps.

    A shard is cut into blocks by bits of the key's first generator state; blocks are counted, their offsets summed over
    a shard's few counts, and rows are numbered within a block, so no task sorts a whole shard. Order: block, then the
    ``order`` columns; rows equal in these get neighbouring slots in any order. A block that is too large all the same, as one key holds most of it,
    is cut by the partitions in which its rows are written first; within it their order counts before the others.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "shard")
    rows, shards = df.agg(F.count("*"), F.count_distinct(shard)).first()
    blocks = 16
    while blocks * BLOCK * max(1, shards) < rows and blocks < 1 << 30:
        blocks *= 2
    hi, lo = halves(shard_key(df, key))
    df = df.withColumn("__block", _step(hi, lo)[0].bitwiseAND(F.lit(blocks - 1))).withColumn("__part", F.lit(0))
    counts = scratch.save(df.groupBy(shard, "__block", "__part").agg(F.count("*").alias("n")), "counts")
    large = counts.where(F.col("n") > 4 * BLOCK).select(F.col(shard).alias("__s"), F.col("__block").alias("__b"), F.lit(True).alias("__large"))
    if not large.isEmpty():
        found = df.join(large, (F.col(shard) == F.col("__s")) & (F.col("__block") == F.col("__b")), "left")
        # equal rows cannot be told apart by any column, only by where they are written
        df = scratch.save(found.withColumn("__part", F.when(F.col("__large"), F.spark_partition_id()).otherwise(0)).drop("__s", "__b", "__large"), "parts")
        counts = df.groupBy(shard, "__block", "__part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(shard).orderBy("__block", "__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = scratch.save(counts.select(F.col(shard).alias("__s"), F.col("__block").alias("__b"), F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__off")), "offsets")
    placed = df.join(offsets, (F.col(shard) == F.col("__s")) & (F.col("__block") == F.col("__b")) & (F.col("__part") == F.col("__p")))
    within = F.row_number().over(Window.partitionBy(shard, "__block", "__part").orderBy(*order))
    return placed.withColumn("slot", F.col("__off") + within - 1).drop("__block", "__part", "__s", "__b", "__p", "__off")


def shard_documents(docs: DataFrame, shards: int = 40, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of each row, law ``key``.

    size is the UTF-8 length of the text plus 16; a null text has no bytes (size 16, checksum 0). A null key counts as 0.
    Rows of one key always share a shard, so repeated rows do. Slots follow (block, key, checksum, size). An empty table gives an empty one.
    """
    body = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    slim = docs.select(F.col(key), (F.length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.lit("key").alias("law"))
    out = number(assign(slim, shards, key), [key, "text_crc32", "size"], key=key)
    return out.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
