"""Line dedup by a segment-partition edit join (operator 6).

Two lines within ``threshold`` edits share one of threshold + 1 segments of the shorter one, near its own place. Lines give keys
of (length, segment, substring) for their own length and for shorter ones, lines that share a key are verified with a
banded bit-parallel edit distance, and near lines form classes of which only the first occurrence stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nearlinks import bucket_rows, classes, mix, only, shared_buckets
from .scratch import Scratch, slices
from .words import row_key

THRESHOLD = 2
#: Shorter lines (in characters) are linked within half the edits only, those under half as long if equal: beyond that
#: lines that say different things (numbers, single words) would be near.
SHORT = 24
#: Letters by how common they are; dealt to kinds in turn, so that no kind is left without common ones.
_COMMON = " etaoinshrdlucmfwypvbgkjqxz"
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) ^ (1 << 63)


def second_id(line: str) -> int:
    """Spark's xxhash64: tells lines apart that share a ``line_id``."""
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """Numbers and stripped forms of the \\n-split lines that hold more than white space."""
    return [(k, s) for k, x in enumerate((text or "").split("\n")) if (s := x.strip(" \t\r\x0b\x0c"))]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def segment_keys(lines: list[str], threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``lines`` and keys: of each line's own segments and of the substrings that can meet a segment of a line
    that is up to ``threshold`` characters shorter."""
    parts = threshold + 1
    body = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(x) for x in lines], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])[:-1]
    up, down = _powers(_BASE, len(body) + 1), _powers(_INVERSE, len(body) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(body + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    rows, keys = [], []
    for less in range(threshold + 1):
        length = size - less
        base, odd = length // parts, length % parts
        for i in range(parts):
            start = i * base + np.maximum(0, i - (parts - odd))
            width = base + (i >= parts - odd)
            for shift in range(max(-i, less - (parts - 1 - i)), min(i, less + (parts - 1 - i)) + 1):
                a = start + shift
                ok = np.flatnonzero((length > 0) & (a >= 0) & (a + width <= size) & (width > 0))
                x = at[ok] + a[ok]
                inner = (total[x + width[ok]] - total[x]) * down[x]
                keys.append(mix(inner ^ mix((length[ok] * 64 + i).astype(np.uint64))))
                rows.append(ok)
    return np.concatenate(rows), np.concatenate(keys)


def within(left: list[str], right: list[str], threshold: int = THRESHOLD) -> np.ndarray:
    """Whether pairs of texts are within ``threshold`` edits: Myers' bit vectors on a band of 2 * threshold + 1 diagonals, all pairs in step.

    Column j holds rows j - threshold to j + threshold in one machine word; vertical differences outside the matrix
    count as +1, and the distance is followed along the band's lowest diagonal, then up the last column.
    """
    n = len(left)
    a_size, b_size = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    near = np.abs(a_size - b_size) <= threshold
    pad = threshold + 1
    grid = int(max(a_size.max(initial=0), b_size.max(initial=0))) + 4 * pad

    def matrix(texts: list[str], fill: int) -> np.ndarray:
        out = np.full((n, grid), fill, np.uint32)
        for k, x in enumerate(texts):
            out[k, pad : pad + len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
        return out

    a, b = matrix(left, 0xFFFFFFFF), matrix(right, 0xFFFFFFFE)
    # rows of the band: d = 0 .. 2t stands for row j - t + d of column j; cells are distances, differences stay in one word
    width = 2 * threshold + 1
    full = np.uint64((1 << width) - 1)
    one = np.uint64(1)
    plus, minus = np.full(n, full, np.uint64), np.zeros(n, np.uint64)
    # before column 0 the band holds D[i] = |i|: rows above 0 do not exist and are kept out by the fill characters
    low = np.full(n, threshold, np.int64)  # distance at the lowest diagonal, row j + t
    result = np.where(b_size == 0, a_size, -1)
    # differences of rows -t+1 .. t against the row above: -1 above row 0 (|i| falls), +1 below
    up_bits = np.uint64(sum(1 << d for d in range(threshold + 1, width)))
    plus[:] = up_bits
    minus[:] = np.uint64(sum(1 << d for d in range(1, threshold + 1)))
    for j in range(1, int(b_size.max(initial=0)) + 1):
        match = np.zeros(n, np.uint64)
        for d in range(width):
            match |= (a[:, pad + j - threshold + d - 1] == b[:, pad + j - 1]).astype(np.uint64) << np.uint64(d)
        # the band moves down one row: bit d now stands for the row that bit d + 1 stood for
        p, m = plus >> one, minus >> one
        p |= np.uint64(1 << (width - 1))
        x = match | m
        zero = ((((x & p) + p) ^ p) | x) & full
        right_up = (m | ~(zero | p)) & full
        right_down = zero & p
        diagonal = (zero >> np.uint64(width - 1)) & one
        low += (1 - diagonal).astype(np.int64)
        hp, hm = (right_up << one) & full, (right_down << one) & full
        plus, minus = (hm | ~(zero | hp)) & full, hp & zero
        last = b_size == j
        if last.any():
            k = np.flatnonzero(last)
            value, p, m = low[k].copy(), plus[k], minus[k]
            for d in range(width - 1, 0, -1):
                step = (a_size[k] - j + threshold) < d
                bit = np.uint64(d)
                value -= np.where(step, ((p >> bit) & one).astype(np.int64) - ((m >> bit) & one).astype(np.int64), 0)
            result[k] = value
    return near & (result >= 0) & (result <= threshold)


def _least(threshold: int, short: int) -> int:
    """The least length of a line that can be near another one."""
    return (short + 1) // 2 if threshold > 1 else short


def _line_keys(lines: list[str], threshold: int, short: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys of lines by which pairs within ``threshold`` edits meet, or within half of that if the shorter line is under ``short``."""
    few, size = threshold // 2, np.array([len(x) for x in lines], np.int64)
    rows, keys = [], []
    for own, edits in ((size >= short, threshold), ((size >= _least(threshold, short)) & (size < short + few), few)):
        own = np.flatnonzero(own)
        if len(own) and edits:
            row, key = segment_keys([lines[k] for k in own], edits)
            rows.append(own[row])
            keys.append(key)
    return (np.concatenate(rows), np.concatenate(keys)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _verify(pairs: DataFrame, threshold: int, short: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            left, right = batch.column("pa").to_pylist(), batch.column("pb").to_pylist()
            order = np.argsort([len(x) for x in right], kind="stable")
            ok = np.zeros(len(left), bool)
            start = 0
            while start < len(order):
                end = start + 1
                while end < len(order) and end - start < 2048 and (end - start) * len(right[order[end]]) < 1 << 20:
                    end += 1
                for edits, part in zip((threshold // 2, threshold), split(order[start:end], left, right), strict=True):
                    if len(part):
                        ok[part] = within([left[k] for k in part], [right[k] for k in part], edits)
                start = end
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    def split(part, left, right):
        tight = np.array([min(len(left[k]), len(right[k])) < short for k in part], bool)
        return part[tight], part[~tight]

    return pairs.mapInArrow(run, "a long, b long")


def _kinds(points: np.ndarray, kinds: int) -> np.ndarray:
    """The kind of each code point: common letters in turn, in both cases, all others by their number."""
    low = np.arange(128)
    for k, x in enumerate(_COMMON):
        low[[ord(x), ord(x.upper())]] = k
    return np.where(points < 128, low[np.minimum(points, 127)], points) % kinds


def _signs(items: DataFrame, threshold: int) -> DataFrame:
    """Characters fall into 2 * threshold + 1 kinds. An edit touches at most two kinds, so near lines have the same sequence
    of characters of at least one kind: its hash is a key."""
    kinds = 2 * threshold + 1

    def run(batches):
        for batch in batches:
            texts = batch.column("payload").to_pylist()
            size = np.array([len(x) for x in texts], np.int64)
            points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
            body = mix(points.astype(np.uint64) + np.uint64(1))
            row, kind = np.repeat(np.arange(len(texts)), size), _kinds(points, kinds)
            keys = np.zeros((kinds, len(texts)), np.uint64)
            for k in range(kinds):
                own = np.flatnonzero(kind == k)
                count = np.bincount(row[own], minlength=len(texts))
                begin = np.concatenate([[0], np.cumsum(count)])
                up, down = _powers(_BASE, len(own) + 1), _powers(_INVERSE, len(own) + 1)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(body[own] * up[:-1], dtype=np.uint64)])
                keys[k] = mix((total[begin[1:]] - total[begin[:-1]]) * down[begin[:-1]] ^ mix((count * kinds + k).astype(np.uint64)))
            ids = batch.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(ids, kinds))], ["key", "id"])

    return items.mapInArrow(run, "key long, id long")


def _counts(line: Column) -> Column:
    """How often each common character stands in the line."""
    return F.array(*(F.regexp_count(line, F.lit(x)) for x in _COMMON))


def _near_counts(threshold: int):
    """An edit changes at most two counts by one."""
    return lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x) <= 2 * threshold


def _occurrences(docs: DataFrame, text: str) -> DataFrame:
    """(key, doc, no, id, second) of all lines; docs: (key, doc, text)."""

    def run(batches):
        for batch in slices(batches, text, 4 << 20):
            rows = [(k, no, line_id(s), second_id(s)) for k, x in enumerate(batch.column(text).to_pylist()) for no, s in lines_of(x)]
            k, no, ids, second = (np.fromiter((r[i] for r in rows), kind, len(rows)) for i, kind in enumerate((np.int64, np.int32, np.uint64, np.uint64)))
            own = batch.select(["key", "doc"]).take(pa.array(k))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(no), pa.array(ids.view(np.int64)), pa.array(second.view(np.int64))], ["key", "doc", "no", "id", "second"])

    kind = lambda c: docs.schema[c].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind('key')}, doc {kind('doc')}, no int, id long, second long")


def _buckets(docs: DataFrame, text: str, threshold: int, short: int) -> DataFrame:
    def run(batches):
        for batch in slices(batches, text, 4 << 20):
            seen = {line_id(s): s for x in batch.column(text).to_pylist() for _, s in lines_of(x) if len(s) >= _least(threshold, short)}
            if not seen:
                continue
            ids = np.fromiter(seen, np.uint64, len(seen))
            rows, keys = _line_keys(list(seen.values()), threshold, short)
            keys, ids, salt = bucket_rows(keys, ids[rows])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids.view(np.int64)), pa.array(salt)], ["key", "id", "salt"])

    return docs.select(text).mapInArrow(run, "key long, id long, salt int")


def _texts(docs: DataFrame, text: str, least: int) -> DataFrame:
    def run(batches):
        for batch in slices(batches, text, 4 << 20):
            seen = {line_id(s): s for x in batch.column(text).to_pylist() for _, s in lines_of(x) if len(s) >= least}
            yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(seen, np.uint64, len(seen)).view(np.int64)), pa.array(list(seen.values()), pa.string())], ["id", "payload"])

    return docs.select(text).mapInArrow(run, "id long, payload string")


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: int = THRESHOLD, short: int = SHORT) -> DataFrame:
    """docs with each line kept once in its class of near-equal lines; adds n_lines and n_removed.

    Lines are compared without white space at their ends; lines of white space only stay and are not counted. Lines of at
    least ``short`` characters are linked within ``threshold`` edits, a line of at least half as many with another one within half the
    edits, still shorter ones if equal; classes are closed under links. The first line of a class, by key
    and line number (null keys first), stays. Equal rows (key and text) count as one document and lose the same lines. Null texts stay null; a text
    that loses all lines is empty; an empty table gives an empty one; an input column named n_lines or n_removed raises ValueError.
    Lines meet by 64-bit hashes; a second one tells two lines of one hash apart, so that such a clash can only lose links of one of them.
    Rows are named by 96 bits.
    """
    if both := {"n_lines", "n_removed"} & set(docs.columns):
        raise ValueError(f"rename these input columns first: {sorted(both)}")
    scratch = Scratch(docs.sparkSession, "lines")
    slim = docs.select(row_key(docs.select(key, text)).alias("key"), F.col(key).alias("doc"), F.col(text).alias("text"))
    buckets = shared_buckets(_buckets(slim, "text", threshold, short), scratch)
    near, held = classes(buckets, lambda ids: only(_texts(slim, "text", _least(threshold, short)), ids, scratch).dropDuplicates(["id"]), lambda pairs: _verify(pairs, threshold, short), lambda items: _signs(items, threshold), scratch, _counts, _near_counts(threshold))
    near = near.join(held.select(F.col("id").alias("of"), F.xxhash64("payload").alias("its")), F.col("id") == F.col("of")).select("of", "its", "component")
    found = scratch.save(_occurrences(slim, "text"), "occurrences")
    # a line without near ones is a class of its own, named by both of its hashes
    single = F.col("component").isNull()
    name = F.struct(F.coalesce("component", "id").alias("id"), F.when(single, F.col("second")).alias("second"))
    named = found.join(near, (F.col("id") == F.col("of")) & (F.col("second") == F.col("its")), "left").select("key", "doc", "no", name.alias("class"))
    place = F.struct("doc", "no", "key")
    several = named.groupBy(F.col("class").alias("c")).agg(F.min(place).alias("first"), F.max(place).alias("end")).where("first <> end").select("c", "first")
    several = scratch.save(several, "several")
    same = (F.col("class.id") == F.col("c.id")) & F.col("class.second").eqNullSafe(F.col("c.second"))
    gone = named.join(several, same).where(~place.eqNullSafe(F.col("first")))
    by_doc = gone.groupBy(F.col("key").alias("__k")).agg(F.collect_set("no").alias("__gone"))
    joined = docs.withColumn("__key", row_key(docs.select(key, text))).join(by_doc, F.col("__key") == F.col("__k"), "left").drop("__key", "__k")
    joined = joined.withColumn("__lines", F.split(text, "\n"))
    n_lines = F.coalesce(F.size(F.filter("__lines", lambda x: x.rlike("[^ \\t\\r\\x0b\\x0c]"))), F.lit(0)).cast("long")
    joined = joined.withColumn("n_lines", F.when(F.col(text).isNull(), F.lit(0)).otherwise(n_lines))
    joined = joined.withColumn("n_removed", F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long"))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    cut = F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n")
    return joined.withColumn(text, F.when(F.col("__gone").isNotNull(), cut).otherwise(F.col(text))).drop("__gone", "__lines")
