"""Benchmark decontamination with an Aho-Corasick automaton (operator 4).

All 13-word windows of the items are patterns of one automaton over normalised text. A document is normalised, scanned
once, and hits are mapped back to words and to character offsets of the original text. A benchmark of more than BLOCK
characters of windows is dealt to blocks by a hash, in a written table; the documents are then scanned once for each block, so that neither the
driver nor a task ever holds more than one automaton.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .scratch import Scratch, slices
from .words import row_key

# A word is a run of 0-9, a-z (after lower-casing A-Z) and everything from U+0080; 13 words are a window.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 13
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Characters of patterns in one automaton, about.
BLOCK = 4 << 20


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_KEEP).split()


def windows(text: str | None) -> list[str]:
    w = words(text)
    return [b" ".join(w[i : i + WINDOW]).decode() for i in range(max(1, len(w) - WINDOW + 1))] if w else []


def window_table(items: DataFrame, item: str, text: str, scratch: Scratch, most: int = BLOCK) -> tuple[DataFrame, int]:
    """(block, window, ids) of the distinct windows with the items that have them, and the number of blocks."""

    def run(batches):
        for batch in slices(batches, "text", 1 << 20):
            lists = [windows(x) for x in batch.column("text").to_pylist()]
            row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(row)), pa.array([w for x in lists for w in x], pa.string())], ["item", "window"])

    slim = items.select(F.col(item).alias("item"), F.col(text).alias("text"))
    each = slim.mapInArrow(run, f"item {slim.schema['item'].dataType.simpleString()}, window string")
    found = scratch.save(each.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("ids")), "windows")
    size = found.agg(F.coalesce(F.sum(F.length("window") + 2), F.lit(0))).first()[0]
    n = max(1, -(-size // most))
    return found.select(F.pmod(F.xxhash64("window"), F.lit(n)).alias("block"), "window", "ids"), n


_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, patterns: list[tuple[str, list[int]]]) -> ahocorasick.Automaton:
    if name not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for window, ids in patterns:
            made.add_word(f" {window} ", (window.count(" ") + 1, ids))
        made.make_automaton()
        _built[name] = made
    return _built[name]


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """Character offsets in the original text of runs of hit words."""
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """docs with n_words, n_hit (words inside an occurrence of a window), ``items`` (sorted ids of the items that
    occur, of the items' own type) and ``spans`` (character offsets of hit runs in the original text).

    An item of fewer than 13 words is one window; one without words has none. Null and empty texts have no words;
    repeated items count once, a null item id is hit but not listed; repeated rows stay; an empty table on either side
    gives no hits; an input column named like an added one raises ValueError.
    """
    if both := {"n_words", "n_hit", "items", "spans"} & set(docs.columns):
        raise ValueError(f"rename these input columns first: {sorted(both)}")
    scratch = Scratch(docs.sparkSession, "benchmark")
    kind, columns = items.schema[item].dataType, docs.columns
    ids_type, positions = pa.list_(to_arrow_type(kind)), pa.list_(pa.int32())
    table, blocks = window_table(items, item, item_text, scratch, block)

    def scan(texts: list[str | None], name: str, patterns: list) -> dict[int, tuple[np.ndarray, set]]:
        """Hit words and items of the texts that have any."""
        found = {}
        read = _automaton(name, patterns).iter if patterns else lambda _: ()
        for k, x in enumerate(texts):
            w = words(x)
            body = f" {b' '.join(w).decode()} " if w else ""
            ends = list(read(body)) if w else []
            if not ends:
                continue
            # the closing space of a window stands before the word that follows it
            space = np.flatnonzero(np.frombuffer(body.encode("utf-32-le"), np.uint32) == 32)
            hit, ids = found.setdefault(k, (np.zeros(len(w), bool), set()))
            for end, (size, own) in ends:
                last = int(np.searchsorted(space, end))
                hit[last - size : last] = True
                ids.update(own)
        return found

    def patterns_of(k: int):
        """One block on the driver, then with every task."""
        rows = table.where(F.col("block") == k).select("window", "ids").toArrow()
        return f"{uuid.uuid4().hex}-{k}", docs.sparkSession.sparkContext.broadcast(list(zip(rows.column("window").to_pylist(), rows.column("ids").to_pylist(), strict=True)))

    def finished(batch: pa.RecordBatch, hits: list, ids: list) -> pa.RecordBatch:
        """hits: numbers of hit words of each row; ids: its items."""
        texts = batch.column(text).to_pylist()
        n = [len(words(x)) for x in texts]
        spans = []
        for x, size, own in zip(texts, n, hits, strict=True):
            hit = np.zeros(size, bool)
            hit[own] = True
            spans.append(_spans(x, hit) if len(own) else [])
        made = [pa.array(n, pa.int64()), pa.array([len(x) for x in hits], pa.int64()), pa.array(ids, ids_type), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
        own = batch.select(columns)
        return pa.RecordBatch.from_arrays([*own.columns, *made], [*own.schema.names, "n_words", "n_hit", "items", "spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    schema = f"{fields}, n_words long, n_hit long, items array<{kind.simpleString()}>, spans array<struct<start:int,end:int>>"
    if blocks == 1:
        name, shared = patterns_of(0)

        def run(batches):
            for batch in slices(batches, text, 32 << 20):
                found = scan(batch.column(text).to_pylist(), name, shared.value)
                none = (np.zeros(0, bool), ())
                both = [found.get(k, none) for k in range(batch.num_rows)]
                yield finished(batch, [np.flatnonzero(hit) for hit, _ in both], [sorted(ids) for _, ids in both])

        return docs.mapInArrow(run, schema)

    # one scan for each block; only documents with hits go through the joins, by the hash that names equal rows
    keyed = docs.withColumn("__key", row_key(docs))
    slim, parts = keyed.select("__key", text), []
    for k in range(blocks):
        name, shared = patterns_of(k)

        def run(batches, name=name, shared=shared):
            for batch in slices(batches, text, 32 << 20):
                found = scan(batch.column(text).to_pylist(), name, shared.value)
                rows = sorted(found)
                hits = [np.flatnonzero(found[r][0]) for r in rows]
                yield pa.RecordBatch.from_arrays([batch.column("__key").take(pa.array(rows, pa.int64())), pa.array(hits, positions), pa.array([sorted(found[r][1]) for r in rows], ids_type)], ["of", "hits", "ids"])

        parts.append(scratch.save(slim.mapInArrow(run, f"of {keyed.schema['__key'].dataType.simpleString()}, hits array<int>, ids array<{kind.simpleString()}>"), f"hits{k}"))
        shared.unpersist()
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.union(part)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    hits = hits.groupBy("of").agg(flat("hits").alias("__hits"), flat("ids").alias("__ids"))
    joined = keyed.join(hits, F.col("__key") == F.col("of"), "left").drop("__key", "of")

    def finish(batches):
        for batch in slices(batches, text, 32 << 20):
            yield finished(batch, [x or [] for x in batch.column("__hits").to_pylist()], [x or [] for x in batch.column("__ids").to_pylist()])

    return joined.mapInArrow(finish, schema)
