"""A distinct-word table joined back to documents: frequent words in each task, the others through a shuffle.

``WordTable`` counts the words that a splitter finds in all texts, lets an encoder see each distinct word once, and
keeps (word, n, value) as a table. The at most HOT most frequent words go to every task as one Arrow table of bounded
size. All other words are exploded with the document's key and their place, joined to the table by word and collected
by document. More than HOT words are more frequent than a word that is shuffled, so none holds over 1/HOT of all
occurrences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, slices

#: At most so many words are frequent. Words longer than LONG bytes are only if among the HOT / 128 most frequent, those over 64 * LONG
#: bytes never, which bounds the broadcast.
HOT, LONG = 1 << 19, 64

#: Bytes of text that a task splits at a time; its arrays take about 25 times as many.
SLICE = 2 << 20

#: splitter(text column of a batch) -> parts (row numbers, words of these rows behind each other, words per row)
Split = Callable[[pa.Array], Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]]

_loaded: dict[str, pa.Table] = {}


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(shared, name: str) -> pa.Table:
    """The broadcast table, read once by each Python worker."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = pa.ipc.open_stream(shared.value).read_all().combine_chunks()
    return _loaded[name]


def places(words: pa.Array, known: pa.Array) -> np.ndarray:
    """The place in ``known`` of each of ``words``, -1 where there is none; both hold distinct words of one type. The many known words are looked
    up among the few of a batch, since Arrow builds the table of the side it looks in anew each time."""
    hit = pc.index_in(known, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(hit >= 0)
    out = np.full(len(words), -1, np.int32)
    out[hit[at]] = at
    return out


def word_counts(docs: DataFrame, text: str, split: Callable[[], Split]) -> DataFrame:
    """(word, n): how often each word stands in the texts."""

    def found(batches):
        cut = split()
        for batch in slices(batches, text, SLICE):
            for _, words, _ in cut(batch.column(text)):
                seen = words.value_counts()
                yield pa.RecordBatch.from_arrays([seen.field("values").cast(pa.string()), seen.field("counts").cast(pa.int64())], ["word", "n"])

    return docs.select(text).mapInArrow(found, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def row_key(docs: DataFrame) -> Column:
    """96 bits that name equal rows: among n rows two share a name with a chance of about n^2 / 2^97."""
    columns = [F.col(f"`{c}`") for c in docs.columns if docs.schema[c].dataType.typeName() not in ("map", "variant")]
    return F.struct(F.xxhash64(*columns).alias("a"), F.hash(*columns).alias("b"))


class WordTable:
    """value_type: Spark type of what ``encode(words) -> Arrow array`` gives for each word. counts: those of ``word_counts``, if known."""

    def __init__(self, docs: DataFrame, text: str, split: Callable[[], Split], encode: Callable[[], Callable[[list[str]], pa.Array]], value_type: str, scratch: Scratch, hot: int = HOT, counts: DataFrame | None = None):
        spark = docs.sparkSession
        self.text, self.split = text, split

        def encoded(batches):
            one = encode()
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, one(batch.column("word").to_pylist())], ["word", "n", "value"])

        counts = word_counts(docs, text, split) if counts is None else counts
        table = scratch.save(counts.mapInArrow(encoded, f"word string, n long, value {value_type}"), "words")
        bytes_of = F.octet_length("word")
        edge, high = self._edges(table, hot, hot // 128)
        frequent = (F.col("n") >= edge) & (bytes_of <= LONG) | (F.col("n") >= high) & (bytes_of <= 64 * LONG)
        self.rare = table.where(~frequent).select("word", "value")
        self.table = table
        # the most frequent first: small codes are the most common ones
        got = table.where(frequent).select("word", "value", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")]).drop_columns(["n"])
        self.name, self.scratch = scratch.root, scratch
        del counts
        scratch.release()
        self.shared = spark.sparkContext.broadcast(_ipc(got))

    @staticmethod
    def _edges(table: DataFrame, *most: int) -> list[float]:
        """Counts that at most so many words reach: from the sizes of classes of counts, sixteen to a doubling."""
        step = F.floor(F.log2(F.col("n")) * 16)
        classes = sorted(table.groupBy(step.alias("k")).agg(F.min("n"), F.count("*")).collect(), reverse=True)
        out = []
        for left in most:
            edge = float("inf")
            for _, low, words in classes:
                left -= words
                if left < 0:
                    break
                edge = float(low)
            out.append(edge)
        return out

    def coded(self, docs: DataFrame, emit: Callable, schema: str) -> DataFrame:
        """docs with ``schema`` columns added: emit(batch, rows, codes, counts, values) gives their arrays.

        codes: the place of each word in ``values`` (of the frequent words), -1 for the others, which are in the added
        column ``rest`` in order. A null text has no words. ``key`` names equal (columns of docs), not rows.
        """
        text, split, shared, name = self.text, self.split, self.shared, self.name

        def run(batches):
            cut = split()
            known = _table(shared, name)
            words_of, values = known.column("word").cast(pa.large_string()), known.column("value")
            words_of, values = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (words_of, values))
            for batch in slices(batches, text, SLICE):
                for rows, words, counts in cut(batch.column(text)):
                    seen = words.dictionary_encode()
                    place = places(seen.dictionary, words_of)
                    codes = place[seen.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int32)
                    miss = codes < 0
                    ends = np.concatenate([[0], np.cumsum(counts)])
                    left = np.concatenate([[0], np.cumsum(miss)])[ends]
                    rest = pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(miss)).cast(pa.string()))
                    own = batch.drop_columns([text]).take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*own.columns, *emit(codes, ends, values), rest], [*own.schema.names, *out_names, "rest"])

        out = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text] + ([schema] if schema else [])
        out_names = [x.split()[0] for x in schema.split(",") if x]
        return docs.mapInArrow(run, ", ".join([*out, "rest array<string>"]))

    def far(self, docs: DataFrame, key: str) -> DataFrame:
        """(key, pos, value) of the words that are not frequent."""
        coded = self.coded(docs.select(key, self.text), lambda codes, ends, values: [], "")
        far = coded.select(key, F.posexplode("rest").alias("pos", "word"))
        met = self.scratch.save(far.join(self.rare, "word").select(key, "pos", "value"), "rest")
        del far
        self.scratch.release()
        return met
