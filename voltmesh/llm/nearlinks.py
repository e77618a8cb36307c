"""Classes of near-equal items from keys that near items share: candidates, verification, components.

The first steps do not list all pairs of a bucket. First each member of a bucket is verified against the bucket's smallest and largest
id. Members of buckets that are then still in several classes get narrower keys, which near items are bound to share
too, and meet in these inside each bucket: again the ends first, then all that are still in different classes. So every
near pair is either verified or already joined by verified links, and a bucket of n alike items costs about 2n checks.
Only items that stay apart under a narrower key meet in pairs: up to n^2 of a group of n that are alike and not near.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Ids of one key in one batch beyond which they are known to share a bucket and need not meet in the shuffle.
LOCAL = 8


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def bucket_rows(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, id, salt) rows of a batch (uint64): distinct; the ids of a crowded key get salts from 1, and one of them also salt 0."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids = keys[new], ids[new]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(keys)))
    crowded = np.repeat(size > LOCAL, size)
    salt = np.where(crowded, 1 + (ids % np.uint64(61)).astype(np.int32), 0).astype(np.int32)
    lead = start[size > LOCAL]
    return np.concatenate([keys, keys[lead]]), np.concatenate([ids, ids[lead]]), np.concatenate([salt, np.zeros(len(lead), np.int32)])


def shared_buckets(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, id) of keys with two or more ids. The only shuffle of all rows."""
    w = Window.partitionBy("key", "salt")
    seen = rows.withColumns({"__low": F.min("id").over(w), "__high": F.max("id").over(w)})
    return scratch.save(seen.where("salt > 0 or __low <> __high").select("key", "id").distinct(), "buckets")


def _star(groups: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): each id with the smallest and the largest id of its key."""
    ends = scratch.save(groups.groupBy(F.col("key").alias("k")).agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high"), "ends")
    pairs = groups.join(ends, F.col("key") == F.col("k")).select("id", F.explode(F.array("low", "high")).alias("end")).where("id <> end")
    return pairs.select(F.least("id", "end").alias("a"), F.greatest("id", "end").alias("b")).distinct()


def _open(groups: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, id, class) of the keys whose ids are in two or more classes."""
    named = groups.join(found.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left").select("key", "id", F.coalesce("component", "id").alias("class"))
    named = scratch.save(named, "classes")
    several = named.groupBy(F.col("key").alias("k")).agg(F.min("class").alias("c"), F.max("class").alias("d")).where("c <> d").select("k")
    return scratch.save(named.join(scratch.save(several, "several"), F.col("key") == F.col("k"), "left_semi"), "open")


def classes(buckets: DataFrame, payload: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame], signs: Callable[[DataFrame], DataFrame], scratch: Scratch, sketch: Callable[[Column], Column] | None = None, maybe: Callable[[Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, component) of items with a verified link, and (id, payload) of all that were looked at.

    payload(ids) gives (id, payload) of the ids in ``id``; verify(pairs) keeps (a, b) of (a, b, pa, pb) that are near;
    signs(items) gives (key, id) of (id, payload) such that near items share a key: with these the items of buckets that the
    first round leaves in several classes meet again, each inside its buckets, so a key that many items of the corpus share
    (that of characters which a line lacks) gathers no more than a bucket. sketch(payload) and maybe(sketch, sketch), if given, tell which pairs cannot be near;
    the last join does not give these out.
    """
    held = scratch.save(payload(buckets.select("id").distinct()), "payload")

    def checked(pairs: DataFrame) -> DataFrame:
        left = held.select(F.col("id").alias("ia"), F.col("payload").alias("pa"))
        right = held.select(F.col("id").alias("ib"), F.col("payload").alias("pb"))
        full = pairs.join(left, F.col("a") == F.col("ia")).join(right, F.col("b") == F.col("ib")).select("a", "b", "pa", "pb")
        return scratch.save(verify(full), "links")

    tried = scratch.save(_star(buckets, scratch), "tried")
    links = checked(tried)
    found = components(links, scratch)
    left = _open(buckets, found, scratch)
    if left.isEmpty():
        return found, held
    wanted = scratch.save(left.select(F.col("id").alias("wanted")).distinct(), "wanted")
    signed = scratch.save(signs(held.join(wanted, F.col("id") == F.col("wanted"), "left_semi")), "signs")
    inside = left.select(F.col("key").alias("bucket"), F.col("id").alias("of"))
    groups = scratch.save(signed.join(inside, F.col("id") == F.col("of")).select(F.xxhash64("bucket", "key").alias("key"), "id"), "groups")
    again = scratch.save(_star(_open(groups, found, scratch), scratch).join(tried, ["a", "b"], "left_anti"), "again")
    links = links.union(checked(again))
    found = components(links, scratch)
    left = _open(groups, found, scratch)
    if left.isEmpty():
        return found, held
    met = (F.col("key") == F.col("key2")) & (F.col("class") < F.col("class2"))
    if sketch and maybe:
        known = held.join(wanted, F.col("id") == F.col("wanted"), "left_semi").select(F.col("id").alias("of"), sketch(F.col("payload")).alias("sketch"))
        left = scratch.save(left.join(known, F.col("id") == F.col("of")).drop("of"), "sketched")
        met &= maybe(F.col("sketch"), F.col("sketch2"))
    pairs = left.join(left.select(*(F.col(c).alias(f"{c}2") for c in left.columns)), met)
    pairs = pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
    more = checked(scratch.save(pairs.join(tried, ["a", "b"], "left_anti").join(again, ["a", "b"], "left_anti"), "rest"))
    return (found if more.isEmpty() else components(links.union(more), scratch)), held


#: Ids that may be broadcast (8 bytes each); more of them are joined by a shuffle.
FEW = 1 << 20


def only(rows: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows whose ``id`` is among ``ids``, broadcast where their count is checked to be small."""
    ids = scratch.save(ids.select(F.col("id").alias("wanted")), "wanted")
    few = ids.count() <= FEW
    return rows.join(F.broadcast(ids) if few else ids, F.col("id") == F.col("wanted"), "left_semi")
