"""Substring dedup by MinHash banding of sliding paragraphs (operator 3).

Each run of SIZE words is a paragraph. Its MinHash is the smallest of its five-word shingles' hashes, among the REACH places at
which SEED words still fit into the paragraph; the band key is the SEED words that begin there. Neighbouring paragraphs
mostly share their MinHash, so a text gives about two keys in REACH + 1 words and not one a word. Colliding paragraphs
are joined with the first of their band, laid side by side along the diagonal of the collision, and verified word by
word: an aligned passage of SIZE or more words, of which at most a fifth are replaced, is repeated; so is one that gets that long if up to GAP words are
put in or left out at each end of what the diagonal gives. What a collision with the first of its band does not cover meets again: each run of SIZE words around its seeds is a narrower key, and members that
share one are linked. Passages that overlap in a text form one node, verified collisions link nodes, and connected components are the classes of which only the first
occurrence stays.

An exact passage of SIZE words always collides, whatever stands around it, since all its paragraphs have the same MinHash; and it is found whole, since each of its members either
runs like the first of the band all along it, or has it among the runs that meet again. So is a
pair of paragraphs of 50 or more words at a five-word Jaccard similarity of 0.8: each break in it costs four shingles at least, of which
such a pair has at most one in nine to lose, so a run of SIZE words is unbroken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .nearlinks import mix
from .scratch import Scratch, flat, slices, strings

SHINGLE, SEED, SIZE = 5, 12, 25
#: Places in a paragraph at which a seed can begin.
REACH = SIZE - SEED + 1
#: Words compared on either side of a collision; what goes on beyond them has collisions of its own.
CONTEXT = 40
#: The share of words of an aligned passage that are the same.
SIMILARITY = 0.8
#: Words that may be put in or left out at either end of a short stretch, and words that must follow alike.
GAP = 2
_ODD = np.uint64(0xD1342543DE82EF95)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z), white-space separated words of all rows behind each other, and the rows' bounds."""
    body, at = flat(column)
    space = (body == 32) | ((body >= 9) & (body <= 13))
    low = np.where((body >= 65) & (body <= 90), body + 32, body).astype(np.uint8)
    start = ~space
    if len(body):
        start[1:] &= space[:-1]
        first = at[:-1][at[:-1] < len(body)]
        start[first] = ~space[first]
    begin = np.flatnonzero(start)
    solid = ~space
    place = np.concatenate([[0], np.cumsum(solid)])
    words = strings(low[solid], np.append(place[begin], place[-1])).dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in words.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(words.dictionary))
    return known[words.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64), np.searchsorted(begin, at)


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hash of each run of n values."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out = out * _ODD + h[k : k + len(out)]
    return mix(out)


def _sliding(value: np.ndarray, reach: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each run of ``reach`` values."""
    out, width = value, 1
    while width < reach:
        step = min(width, reach - width)
        out = pick(out[:-step], out[step:])
        width += step
    return out


def _lowest(value: np.ndarray, doc: np.ndarray, reach: int) -> np.ndarray:
    """Whether a place holds the smallest value of some ``reach`` neighbouring places of one document; equal ones all do."""
    spans = len(value) - reach + 1
    if spans <= 0:
        return np.zeros(len(value), bool)
    low = np.where(doc[:spans] == doc[reach - 1 :], _sliding(value, reach, np.minimum), np.uint64(0))
    edge = np.zeros(reach - 1, np.uint64)
    return _sliding(np.concatenate([edge, low, edge]), reach, np.maximum) == value


def band_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the row and band key of each place that is the MinHash of a paragraph; texts under SIZE words have none."""
    h, bound = word_hashes(column)
    doc = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
    places = max(0, len(h) - SEED + 1)
    inside = np.flatnonzero(doc[:places] == doc[len(doc) - places :])
    shingle = _runs(h, SHINGLE)
    at = inside[_lowest(shingle[inside], doc[inside], REACH)]
    return doc[at], at - bound[doc[at]], _runs(h, SEED)[at]


def _keys(texts: DataFrame) -> DataFrame:
    """(band, tid, at) of all paragraphs."""

    def run(batches):
        for batch in slices(batches, "text", 4 << 20):
            row, at, key = band_keys(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("tid").take(pa.array(row)), pa.array(at.astype(np.int32))], ["band", "tid", "at"])

    return texts.select("tid", "text").mapInArrow(run, "band long, tid long, at int")


def _lists(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """values[start : start + size] of each."""
    bounds = np.concatenate([[0], np.cumsum(size)])
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values[np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])]))


def _around(asked: DataFrame) -> DataFrame:
    """(tid, ask, words): up to CONTEXT word hashes from each asked place, nearest first. asked: tid, text, asks; an ask
    is twice the place, plus 1 for the words after it and not before it."""

    def run(batches):
        for batch in slices(batches, "text", 4 << 20):
            h, bound = word_hashes(batch.column("text"))
            short = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            lists = batch.column("asks")
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            ask = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at, after = bound[row] + ask // 2, ask % 2 == 1
            size = np.minimum(np.where(after, bound[row + 1] - at, at - bound[row]), CONTEXT)
            both = np.concatenate([short[::-1], short])
            yield pa.RecordBatch.from_arrays([batch.column("tid").take(pa.array(row)), pa.array(ask.astype(np.int32)), _lists(both, np.where(after, len(h) + at, len(h) - at), size)], ["tid", "ask", "words"])

    return asked.mapInArrow(run, "tid long, ask int, words array<int>")


class _Words:
    """Lists of word hashes of a batch."""

    def __init__(self, column: pa.Array):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        at = column.offsets.to_numpy()
        self.flat = np.append(column.values.to_numpy(zero_copy_only=False), 0)
        self.at, self.size = at[:-1], np.diff(at)

    def rows(self, rows: np.ndarray, skip: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The words from ``skip`` on, a row each, and which of them there are."""
        place = skip[:, None] + np.arange(width)
        there = place < self.size[rows][:, None]
        return self.flat[np.where(there, self.at[rows][:, None] + place, len(self.flat) - 1)], there


def _goes_on(own: _Words, far: _Words, rows: np.ndarray, i: np.ndarray, j: np.ndarray, differ: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(best, exact): how many words both sides go on alike from places i and j. best: the longest stretch that ends in the same word and of which at
    most one in ``differ`` is replaced; exact: the words up to the first that is."""
    (a, ta), (b, tb) = own.rows(rows, i, width), far.rows(rows, j, width)
    same = (a == b) & ta & tb
    n = np.arange(1, width + 1)
    good = same & (np.cumsum(~same, axis=1) * differ <= n)
    return np.where(good, n, 0).max(axis=1, initial=0), np.cumprod(same, axis=1).sum(axis=1)


def _reach(own: _Words, far: _Words, before: np.ndarray, differ: int) -> list[np.ndarray]:
    """(best, exact, na, nb) of each row: as above, and how far the two sides reach if, where ``before`` and best do not make SIZE words, up to GAP words
    stand on one of them only."""
    every, none = np.arange(len(before)), np.zeros(len(before), np.int64)
    best, exact = _goes_on(own, far, every, none, none, differ, CONTEXT)
    na, nb, most = best.copy(), best.copy(), np.zeros(len(best), np.int64)
    short = np.flatnonzero(before + best < SIZE) if differ < 1 << 20 else every[:0]
    for i, j in [(k, 0) for k in range(1, GAP + 1)] + [(0, k) for k in range(1, GAP + 1)]:
        more, alike = _goes_on(own, far, short, best[short] + i, best[short] + j, differ, SIZE)
        more = np.where(alike >= 2, more, 0)  # words that go on alike at once
        good = (more >= SHINGLE) & (more > most[short])
        rows = short[good]
        most[rows], na[rows], nb[rows] = more[good], best[rows] + i + more[good], best[rows] + j + more[good]
    return [best, exact, na, nb]


def _text_id(text: Column) -> tuple[Column, Column]:
    """128 bits of a text."""
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def _numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(h1, h2, low, copies, tid): each distinct text with its smallest key, in the order of which it is numbered without gaps in the high bits
    (null keys last). rows: distinct (doc, h1, h2)."""
    found = scratch.save(rows.groupBy("h1", "h2").agg(F.min("doc").alias("low"), F.count("*").alias("copies")), "texts")
    order = [F.col("low").asc_nulls_last(), "h1", "h2"]
    placed = scratch.save(found.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("place", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())  # one row for each partition
    before, starts = 0, []
    for r in sizes:
        starts.append((r["part"], before))
        before += r["count"]
    starts = placed.sparkSession.createDataFrame(starts, "part long, start long")
    return placed.join(F.broadcast(starts), part == F.col("part")).select("h1", "h2", "low", "copies", (F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("tid"))


def _collisions(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(tid, start, end, other, shift): stretches of words along which a text runs like the first text of its bands, ``shift`` words further on."""
    keys = scratch.save(_keys(texts), "bands")
    place = F.struct("tid", "at")
    firsts = keys.groupBy(F.col("band").alias("b")).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    firsts = scratch.save(firsts.select("b", F.col("first.tid").alias("other"), F.col("first.at").alias("there")), "firsts")
    met = keys.join(firsts, F.col("band") == F.col("b")).select("tid", "at", "other", (F.col("at") - F.col("there")).alias("shift"))
    met = met.where(f"tid <> other or shift >= {SIZE}")
    line = Window.partitionBy("tid", "other", "shift").orderBy("at")
    # two seeds along one diagonal at most REACH words apart leave two words between them unseen
    met = met.withColumn("new", F.coalesce((F.col("at") - F.lag("at").over(line) > REACH).cast("int"), F.lit(1)))
    met = met.withColumn("run", F.sum("new").over(line))
    met = scratch.save(met.groupBy("tid", "other", "shift", "run").agg(F.min("at").alias("start"), (F.max("at") + SEED).alias("end")).drop("run"), "collisions")
    _forget(scratch, keys, firsts)
    return met


def _forget(scratch: Scratch, *tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, and let Spark delete what it shuffled for them."""
    for t in tables:
        scratch.drop(t)
    scratch.release()


def _extended(texts: DataFrame, collisions: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """The collisions (tid, start, end, other, shift) with (low, high, olow, ohigh), as far as they go on alike on both sides, and (xlow, xhigh), as far as no word beside the seeds is replaced."""
    ask = lambda at, after: (F.col(at) * 2 + after).cast("int")
    sides = {"own": ("tid", ask("start", 0), ask("end", 1)), "far": ("other", ask("start", 0) - 2 * F.col("shift"), ask("end", 1) - 2 * F.col("shift"))}
    met = collisions
    asks = met.select(F.explode(F.array(*(F.struct(F.col(t).alias("of"), a.alias("ask")) for t, *both in sides.values() for a in both))).alias("x")).select("x.*").distinct()
    asked = texts.join(asks.groupBy("of").agg(F.collect_list("ask").alias("asks")), F.col("tid") == F.col("of")).select("tid", "text", "asks")
    around = scratch.save(_around(asked), "around")
    differ = round(1 / (1 - similarity)) if similarity < 1 else 1 << 20
    sums = ["best", "exact", "na", "nb"]
    for name, k in (("left", 1), ("right", 2)):
        for side, (text, *both) in sides.items():
            known = around.where(F.col("ask") % 2 == k - 1).select(F.col("tid").alias("of"), F.col("ask").alias("at_ask"), F.col("words").alias(side))
            met = met.join(known, (F.col(text) == F.col("of")) & (both[k - 1] == F.col("at_ask"))).drop("of", "at_ask")
        kept = [f for f in met.schema.fields if f.name not in ("own", "far")]

        def run(batches, name=name, kept=kept):
            for batch in batches:
                if not batch.num_rows:
                    continue
                number = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
                before = number("end") - number("start") + (number("left_best") if name == "right" else 0)
                got = _reach(_Words(batch.column("own")), _Words(batch.column("far")), before, differ)
                own = batch.select([f.name for f in kept])
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(x.astype(np.int32)) for x in got)], [*own.schema.names, *(f"{name}_{c}" for c in sums)])

        fields = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), *(f"{name}_{c} int" for c in sums)])
        done = scratch.save(met.mapInArrow(run, fields), name)
        _forget(scratch, *([before] if name == "right" else []))
        met = before = done
    plain = F.col("end") - F.col("start") + F.col("left_best") + F.col("right_best") >= SIZE
    reach = lambda name, part: F.when(plain, F.col(f"{name}_best")).otherwise(F.col(f"{name}_{part}"))
    start, end = F.col("start") - F.col("shift"), F.col("end") - F.col("shift")
    spans = {"low": F.col("start") - reach("left", "na"), "high": F.col("end") + reach("right", "na"), "olow": start - reach("left", "nb"), "ohigh": end + reach("right", "nb")}
    exact = {"xlow": F.col("start") - F.col("left_exact"), "xhigh": F.col("end") + F.col("right_exact")}
    _forget(scratch, collisions, around)
    return met.select("tid", "start", "end", "other", *(v.alias(k) for k, v in (spans | exact).items()))


def _again(texts: DataFrame, extended: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (tid, low, high, other, olow, ohigh) of exact passages among members of a band that its first does not cover."""
    first, last = F.greatest(F.lit(0), F.col("start") - (SIZE - SEED)), F.col("end") - SEED
    reach = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    covered = F.col("xhigh") - F.col("xlow") >= SIZE
    open_ones = F.when(covered, F.array(reach(first, F.least(F.col("xlow") - 1, last)), reach(F.greatest(F.col("xhigh") - SIZE + 1, first), last))).otherwise(F.array(reach(first, last)))
    left = extended.select("tid", F.explode(open_ones).alias("r")).where("r.a <= r.b").select("tid", "r").distinct()
    asked = texts.join(left.groupBy(F.col("tid").alias("of")).agg(F.collect_list("r").alias("asks")), F.col("tid") == F.col("of")).select("tid", "text", "asks")

    def run(batches):
        for batch in slices(batches, "text", 4 << 20):
            h, bound = word_hashes(batch.column("text"))
            key = _runs(h, SIZE).view(np.int64)
            lists = batch.column("asks")
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            ends = lists.flatten()
            a, b = (ends.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            b = np.minimum(b, bound[row + 1] - bound[row] - SIZE)
            size = np.maximum(0, b - a + 1)
            row = np.repeat(row, size)
            place = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
            both = np.unique(np.stack([row, place]), axis=1) if len(row) else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key[bound[both[0]] + both[1]]), batch.column("tid").take(pa.array(both[0])), pa.array(both[1].astype(np.int32))], ["run", "tid", "at"])

    keys = scratch.save(asked.mapInArrow(run, "run long, tid long, at int"), "runs")
    place = F.struct("tid", "at")
    firsts = keys.groupBy(F.col("run").alias("r")).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    firsts = scratch.save(firsts.select("r", F.col("first.tid").alias("other"), F.col("first.at").alias("there")), "first_runs")
    met = keys.join(firsts, F.col("run") == F.col("r")).select("tid", "at", "other", (F.col("at") - F.col("there")).alias("shift")).where(f"tid <> other or shift >= {SIZE}")
    line = Window.partitionBy("tid", "other", "shift").orderBy("at")
    met = met.withColumn("new", F.coalesce((F.col("at") - F.lag("at").over(line) > 1).cast("int"), F.lit(1)))
    met = met.withColumn("part", F.sum("new").over(line))
    whole = met.groupBy("tid", "other", "shift", "part").agg(F.min("at").alias("low"), (F.max("at") + SIZE).alias("high"))
    return whole.select("tid", "low", "high", "other", (F.col("low") - F.col("shift")).alias("olow"), (F.col("high") - F.col("shift")).alias("ohigh"))


def _verified(texts: DataFrame, met: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(tid, start, end, other, ostart, oend): passages of SIZE words and more that a text shares with another one, or with itself."""
    extended = _extended(texts, met, similarity, scratch)
    found = extended.where(f"least(high - low, ohigh - olow) >= {SIZE}").select("tid", "low", "high", "other", "olow", "ohigh").union(_again(texts, extended, scratch)).distinct()
    found = scratch.save(found.toDF("tid", "start", "end", "other", "ostart", "oend"), "verified")
    _forget(scratch, extended)
    return found


def _merged(found: DataFrame) -> DataFrame:
    """found (tid, start, end) with ``node``: the text and the first word of the spans that overlap or touch."""
    line = Window.partitionBy("tid").orderBy("start", "end")
    reach = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    out = found.withColumn("head", F.when(reach.isNull() | (F.col("start") > reach), F.col("start")))
    out = out.withColumn("head", F.last("head", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return out.select("tid", "start", "end", F.struct("tid", "head").alias("node"))


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document with a passage that occurs elsewhere, in it or in another one: (key, row_key, class_id, firsts, repeated, removed).

    repeated: word spans [start, end) of its shared passages, merged; removed: those words of them that stand in an earlier
    place too (by key, then text, then place; null keys last); firsts: sorted distinct keys of the documents that hold the first occurrences of
    its classes; class_id: the smallest of these. Words are separated by white space and compared in lower case (A-Z).
    A passage has at least 25 words, of which in an occurrence at most 1 - ``similarity`` are replaced, or up to two are put in or left out beside a stretch that is too short without. Equal texts are read once, and all but the
    first document of them are removed as a whole; texts under 25 words have no passage. Equal rows (key and text) are one document. Within a text, occurrences
    under 25 words apart are left alone. Null and empty texts and empty tables give no rows; a text of any length is one task's, at some 25 times its bytes; columns other than key and text are not read;
    a key named like an added column raises ValueError. ``row_key`` is a 128-bit hash of the text.
    """
    if key in {"row_key", "class_id", "firsts", "repeated", "removed"}:
        raise ValueError(f"rename the key column first: {key}")
    scratch = Scratch(docs.sparkSession, "substrings", tidy=True)
    h1, h2 = _text_id(F.col(text))
    slim = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), h1.alias("h1"), h2.alias("h2")).where(F.octet_length("text") >= 2 * SIZE - 1)
    rows = scratch.save(slim.select("doc", "h1", "h2").distinct(), "rows")
    numbered = scratch.save(_numbered(rows, scratch), "ids")
    each = slim.groupBy("h1", "h2").agg(F.any_value("text").alias("text")).join(numbered, ["h1", "h2"])
    size = F.when(F.col("copies") > 1, F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+"))).otherwise(0)
    texts = scratch.save(each.select("tid", size.alias("n"), "text"), "text")
    links = _verified(texts, _collisions(texts, scratch), similarity, scratch)
    there = links.select(F.col("other").alias("tid"), F.col("ostart").alias("start"), F.col("oend").alias("end"))
    spans_of = scratch.save(_merged(links.select("tid", "start", "end").union(there).distinct()), "nodes")
    node = lambda name: spans_of.select(F.col("tid").alias("t"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("node").alias(name))
    own = (F.col("tid") == F.col("t")) & (F.col("start") == F.col("s")) & (F.col("end") == F.col("e"))
    far = (F.col("other") == F.col("t")) & (F.col("ostart") == F.col("s")) & (F.col("oend") == F.col("e"))
    edges = links.join(node("a"), own).drop("t", "s", "e").join(node("b"), far).select("a", "b").distinct()
    found = components(scratch.save(edges, "edges"), scratch)
    nodes = spans_of.groupBy("node").agg(F.first("tid").alias("tid"), F.min("start").alias("start"), F.max("end").alias("end"))
    heads = nodes.join(found, F.col("node") == F.col("id"), "left").withColumn("head", F.coalesce("component", "node")["tid"])
    lows = numbered.select(F.col("tid").alias("of"), F.col("low").alias("first"))
    span = F.struct("start", "end")
    whole = heads.join(lows, F.col("head") == F.col("of")).groupBy(F.col("tid").alias("of")).agg(F.array_sort(F.collect_set("first")).alias("firsts"), F.array_sort(F.collect_list(span)).alias("repeated"))
    cut = links.groupBy(F.col("tid").alias("to")).agg(F.array_sort(F.collect_set(span)).alias("removed"))
    counts = texts.select(F.col("tid").alias("counted"), "n").where(f"n >= {SIZE}")
    about = numbered.join(counts, F.col("tid") == F.col("counted"), "left").join(whole, F.col("tid") == F.col("of"), "left").join(cut, F.col("tid") == F.col("to"), "left")
    about = scratch.save(about.where("counted is not null or of is not null").select("h1", "h2", "low", "n", "firsts", "repeated", "removed"), "found")
    out = rows.join(about, ["h1", "h2"])
    copy, none = F.col("n").isNotNull(), F.array().cast("array<struct<start:int,end:int>>")
    all_of = F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end")))
    firsts = F.coalesce("firsts", F.filter(F.array("low"), lambda x: x.isNotNull()))
    firsts = F.when(copy & F.col("low").isNotNull(), F.array_sort(F.array_union(firsts, F.array("low")))).otherwise(firsts)
    later = copy & ~F.col("doc").eqNullSafe(F.col("low"))
    return out.select(
        F.col("doc").alias(key), F.struct("h1", "h2").alias("row_key"), F.array_min(firsts).alias("class_id"), firsts.alias("firsts"),
        F.when(copy, all_of).otherwise(spans("repeated")).alias("repeated"), F.when(later, all_of).otherwise(spans(F.coalesce("removed", none))).alias("removed"),
    )


def spans(found):
    """Merged [start, end) spans from sorted ones."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(acc, x):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(F.size(acc) == 0, F.array(x)).when(x["start"] <= last["end"], grown).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(found, empty, add)


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """docs without the words of repeated passages that are not first occurrences; a cut text has its words joined by spaces.
    Other columns stay, whatever their names (but ``__cut``, ``__key``, ``__h1`` and ``__h2``)."""
    cut = repeats(docs, text, key, similarity).where(F.size("removed") > 0).select(F.col(key).alias("__key"), F.col("row_key.h1").alias("__h1"), F.col("row_key.h2").alias("__h2"), F.col("removed").alias("__cut"))
    h1, h2 = _text_id(F.col(text))
    joined = docs.join(cut, (h1 == F.col("__h1")) & (h2 == F.col("__h2")) & F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key", "__h1", "__h2")
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    kept = F.filter(words, lambda _, i: ~F.exists("__cut", lambda s: (i >= s["start"]) & (i < s["end"])))
    return joined.withColumn(text, F.when(F.col("__cut").isNotNull(), F.array_join(kept, " ")).otherwise(F.col(text))).drop("__cut")
