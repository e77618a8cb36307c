"""Alignment of two tokenizers over the bytes of each text (operator 13).

A is a byte-level BPE (``tokenizers``), B a BPE with byte fallback (``sentencepiece``). Both cut " " + text; the ends of their tokens, as byte
offsets, are united, and each interval between neighbouring ends is the overlap of one A token and one B token: a link. Ends that both
have close a group. Neither tokenizer joins anything across a space between two characters that are no white space, so texts are cut there into units and each task aligns a
unit once, all units of a slice at a time over arrays. Counts of linked ids are summed over the corpus in a first pass; the second one
adds them up by document: the most frequent pairs are in each task, the others come through a join.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .scratch import Scratch, flat, slices, strings
from .words import WordTable

#: Bytes of text that a task cuts at a time; a longer text is taken in parts.
SLICE = 3 << 20
#: Units (of at most UNIT bytes) that a worker remembers, and pairs of ids that go to every task: bounds on memory, not on what is counted.
UNITS, UNIT, HOT = 1 << 17, 64, 1 << 20
#: Units beyond so many bytes are encoded on their own, by libraries that take a word of any length.
LONG = 1 << 14
#: Distinct pairs that a task gathers before it gives them out.
PAIRS = 1 << 21

_PRINTED = np.zeros(256, bool)  # bytes beside which a space surely stands between two characters that are no white space
_PRINTED[0x21:0x7F] = True
_OPENS = _PRINTED.copy()  # the same for the first byte of a character; Unicode's white space begins with C2, E1, E2 or E3
_OPENS[0xC3:0xF5] = True
_OPENS[[0xE1, 0xE2, 0xE3, 0xEF]] = False


def _cuts(body: np.ndarray) -> np.ndarray:
    """Where units begin inside the bytes of texts that lie behind each other: at single spaces."""
    at = np.flatnonzero(body[3:-1] == 0x20) + 3 if len(body) > 4 else np.zeros(0, np.int64)
    last = body[at - 1]
    wide = (last >= 0x80) & (body[at - 2] != 0xC2) & ~np.isin(body[at - 3], (0xE1, 0xE2, 0xE3, 0xEF))
    return at[(_PRINTED[last] | wide) & _OPENS[body[at + 1]]]


def units(column: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """(row numbers, units of these rows behind each other, ends of the rows' units); one row longer than SLICE comes in several parts."""
    rows = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(column), 0), False).to_numpy(zero_copy_only=False))
    if not len(rows):
        return
    empty, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    body, at = flat(pc.binary_join_element_wise(empty, column.take(pa.array(rows)).cast(pa.large_string()), space))
    if len(rows) > 1:
        begin = _union1d(_cuts(body), at[:-1])
        yield rows, strings(body, np.append(begin, len(body))), np.searchsorted(begin, at[1:])
        return
    start, size = 0, SLICE
    while start < len(body):
        part = body[start : start + size]
        begin = _union1d(_cuts(part), np.zeros(1, np.int64))
        if start + size < len(body):
            if len(begin) == 1:  # no space yet
                size *= 2
                continue
            part, begin = part[: begin[-1]], begin[:-1]
        yield rows, strings(part, np.append(begin, len(part))), np.array([len(begin)])
        start, size = start + len(part), SLICE


def _byte_level() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printed ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def bytes_of_a(path: str) -> list[bytes]:
    with open(path, encoding="utf-8") as file:
        plain = json.load(file)
    byte = _byte_level()
    out = [b""] * (max(plain["model"]["vocab"].values()) + 1)
    for piece, k in plain["model"]["vocab"].items():
        out[k] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
    return out


def bytes_of_b(path: str) -> list[bytes]:
    b = sentencepiece.SentencePieceProcessor(model_file=path)
    piece = b.id_to_piece
    return [bytes([int(piece(k)[3:-1], 16)]) if b.is_byte(k) else piece(k).replace("▁", " ").encode() for k in range(b.get_piece_size())]


def _union1d(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """numpy's union1d of two sorted arrays: a stable sort merges them."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both


class Aligner:
    """What a unit gives: its numbers of A and B tokens, groups and links, the text of its groups and its links as a << 32 | b.

    ``rows(units)`` -> (table of units, number of each unit in it). Units that were seen before are remembered; the rarer half goes
    when there are too many.
    """

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        of_a, of_b = bytes_of_a(a), bytes_of_b(b)
        special = {x.content for x in self.a.get_added_tokens_decoder().values()}
        ranks = {x: k for k, x in enumerate(of_a) if x and x.decode("utf-8", "replace") not in special}
        # the same vocabulary and order of merges, several times as fast; for Latin text, on which no two versions of Unicode differ
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [pa.array(x, pa.large_binary()) for x in (of_a, of_b)]
        self.sizes = [pc.binary_length(x).to_numpy() for x in self.bytes]
        self.names = [pa.array([str(k) for k in range(len(x))], pa.large_string()) for x in self.bytes]
        self.known = self.align(pa.array([], pa.large_string()))
        self.uses = np.zeros(0, np.int64)

    def _alone(self, found: list[str], side: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units behind each other and how many each has, each unit on its own."""
        lists = []
        for start in range(0, len(found), 2000):  # an encoding is far larger than its ids
            some = found[start : start + 2000]
            lists += self.b.encode([x[1:] for x in some], num_threads=1) if side else [e.ids for e in self.a.encode_batch(some, add_special_tokens=False)]
        return np.fromiter((k for x in lists for k in x), np.int64), np.fromiter(map(len, lists), np.int64, len(lists))

    def _together(self, found: pa.Array, side: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for units that begin and end as inside a text: neighbours do not touch each other, so a thousand at a time are one text."""
        ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        body, at = flat(found)
        raw = body.tobytes()
        for start in range(0, len(found), 1000):
            edge = at[start : start + 1001]
            text = raw[edge[0] : edge[-1]].decode()
            got = np.asarray(self.b.encode(text[1:]) if side else self.fast.encode_to_numpy(text, disallowed_special=()), np.int64)
            ends, close = np.cumsum(self.sizes[side][got]), edge[1:] - edge[0]
            last = np.searchsorted(ends, close)
            if len(ends) and ends[-1] == close[-1] and (ends[last] == close).all():
                ids.append(got)
                counts.append(np.diff(np.concatenate([[-1], last])))
            else:
                own = self._alone(found.slice(start, 1000).to_pylist(), side)
                ids.append(own[0])
                counts.append(own[1])
        return np.concatenate(ids), np.concatenate(counts)

    @staticmethod
    def _inner(found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Units that begin and end as inside a text, and those of ASCII and Latin letters up to U+024F."""
        body, at = flat(found)
        size = np.diff(at)
        room = np.concatenate([np.zeros(3, np.uint8), body, np.zeros(3, np.uint8)])
        last = room[at[1:] + 2]
        wide = (last >= 0x80) & (room[at[1:] + 1] != 0xC2) & ~np.isin(room[at[1:]], (0xE1, 0xE2, 0xE3, 0xEF))
        odd = np.concatenate([[0], np.cumsum(body == 0xE2)])  # U+2581 is among these
        inner = (size > 2) & (size <= LONG) & (room[at[:-1] + 3] == 0x20) & _OPENS[room[at[:-1] + 4]] & (_PRINTED[last] | wide) & (odd[at[1:]] == odd[at[:-1]])
        far = np.concatenate([[0], np.cumsum((body >= 0xCA) | (body == 0xC2))])
        return inner, far[at[1:]] == far[at[:-1]]

    def align(self, found: pa.Array) -> pa.Table:
        """A row for each unit, in the same order."""
        inner, latin = self._inner(found)
        kinds = [np.flatnonzero(x) for x in (inner & latin, inner & ~latin, ~inner)]
        tables = []
        for kind, rows in enumerate(kinds):
            some = found.take(pa.array(rows))
            a = self._together(some, 0) if kind == 0 else self._alone(some.to_pylist(), 0)
            b = self._together(some, 1) if kind < 2 else self._alone(some.to_pylist(), 1)
            tables.append(self._table(some, *a, *b))
        order = np.argsort(np.concatenate(kinds), kind="stable")
        return pa.concat_tables(tables).take(pa.array(order)).combine_chunks()

    def _table(self, found: pa.Array, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> pa.Table:
        n = len(found)
        whole = np.ones(n, bool)
        for ids, counts, table in ((a, n_a, self.bytes[0]), (b, n_b, self.bytes[1])):
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            joined = pc.binary_join(pa.ListArray.from_arrays(offsets, table.take(pa.array(ids)).cast(pa.binary())), b"")
            whole &= pc.equal(joined.cast(pa.large_binary()), found.cast(pa.large_binary())).to_numpy(zero_copy_only=False)
        # units that do not come back have no tokens; all others cover the same bytes on both sides
        a, b = a[np.repeat(whole, n_a)], b[np.repeat(whole, n_b)]
        n_a, n_b = np.where(whole, n_a, 0), np.where(whole, n_b, 0)
        end_a, end_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        ends = _union1d(end_a, end_b)
        of_a, of_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)  # the owners of each interval
        shut = (end_a[of_a] == ends) & (end_b[of_b] == ends) if len(ends) else np.zeros(0, bool)
        last_a, last_b = of_a[shut] + 1, of_b[shut] + 1  # a group's tokens end here
        sides = []
        for ids, last, names in ((a, last_a, self.names[0]), (b, last_b, self.names[1])):
            offsets = pa.array(np.concatenate([[0], last]), pa.int32())
            sides.append(pc.binary_join(pa.ListArray.from_arrays(offsets, names.take(pa.array(ids)).cast(pa.string())), ","))
        groups = pc.binary_join_element_wise(*sides, "|")
        unit_end = np.cumsum(n_a)  # A tokens up to each unit's end
        links_at = np.searchsorted(of_a, unit_end, side="left") if len(of_a) else np.zeros(n, np.int64)
        groups_at = np.searchsorted(last_a, unit_end, side="right") if len(last_a) else np.zeros(n, np.int64)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], groups_at]), pa.int32()), groups), ";")
        links = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], links_at]), pa.int32()), pa.array(a[of_a] << 32 | b[of_b], pa.int64()))
        count = lambda at: np.diff(np.concatenate([[0], at]))
        columns = {"unit": found, "whole": whole, "n_a": n_a, "n_b": n_b, "n_groups": count(groups_at), "n_links": count(links_at)}
        return pa.table({**columns, "text": text, "links": links})

    def rows(self, found: pa.Array) -> tuple[pa.Table, np.ndarray]:
        seen = found.dictionary_encode()
        codes, distinct = seen.indices.to_numpy(zero_copy_only=False).astype(np.int64), seen.dictionary
        known = self.known.column("unit").combine_chunks()
        known = known.chunk(0) if isinstance(known, pa.ChunkedArray) else known
        place = pc.index_in(distinct, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        table = self.known
        if len(new):
            table = pa.concat_tables([self.known, self.align(distinct.take(pa.array(new)))]).combine_chunks()
            place[new] = len(self.known) + np.arange(len(new))
        self._remember(table, place, np.bincount(codes, minlength=len(distinct)))
        return table, place[codes]

    def _remember(self, table: pa.Table, place: np.ndarray, counts: np.ndarray) -> None:
        uses = np.concatenate([self.uses, np.zeros(len(table) - len(self.uses), np.int64)])
        uses[place] += counts
        short = pc.less_equal(pc.binary_length(table.column("unit")), UNIT).to_numpy()
        if len(table) <= UNITS and short[len(self.known) :].all():
            self.known, self.uses = table, uses
            return
        keep = np.flatnonzero(short)
        if len(keep) > UNITS:
            keep = np.sort(keep[np.argsort(-uses[keep], kind="stable")[: UNITS // 2]])
        self.known, self.uses = table.take(pa.array(keep)).combine_chunks(), uses[keep] // 2


_made: dict[tuple[str, str], Aligner] = {}


def _aligner(a: str, b: str) -> Aligner:
    """One for each Python worker."""
    if (a, b) not in _made:
        _made.clear()
        _made[a, b] = Aligner(a, b)
    return _made[a, b]


def _lists(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Links of all units of a table behind each other, and their offsets."""
    lists = table.column("links").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    reach = np.concatenate([[0], np.cumsum(values)])
    return np.diff(reach[at])


def _parts(batch: pa.RecordBatch, text: str, aligner: Aligner):
    """(row numbers, ends of their units, table of units, number of each unit)."""
    for rows, found, ends in units(batch.column(text)):
        yield rows, ends, *aligner.rows(found)


def _sorted_counts(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs or what its weights sum to."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(begin, len(keys))
    reach = np.arange(len(keys) + 1) if weights is None else np.concatenate([[0], np.cumsum(weights)])
    return keys[begin], np.diff(reach[ends])


def _packed(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Pairs in order and their counts: steps between neighbours as planes of bytes, which compress well."""
    steps = np.diff(pairs, prepend=0)
    return zstandard.ZstdCompressor(level=3).compress(np.stack([steps, times]).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()) if len(pairs) else b""


def _unpacked(packed: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if not packed:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    steps, times = np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1).T).view("<i8").reshape(2, -1)
    return np.cumsum(steps), times


_SUMS = ["n_a", "n_b", "n_groups", "n_links"]


def _coded(docs: DataFrame, a: str, b: str, text: str, digest: bool) -> DataFrame:
    """docs without the text, with the four numbers, ``__groups``, ``__row`` (a number of the row) and ``__links`` (its pairs with their counts)."""
    kept = [f for f in docs.schema.fields if f.name != text]

    def run(batches):
        aligner = _aligner(a, b)
        task, made = TaskContext.get().partitionId() << 36, 0
        for batch in slices(batches, text, SLICE):
            size = batch.num_rows
            sums = {c: np.zeros(size, np.int64) for c in _SUMS}
            told: list[str] = [""] * size
            linked: list[bytes] = [b""] * size
            broken = np.zeros(size, bool)
            state, pieces, held = hashlib.sha256(), [], []
            for part, (rows, ends, table, codes) in enumerate(_parts(batch, text, aligner)):
                at = np.concatenate([[0], ends])
                broken[rows] |= _sums(~table.column("whole").to_numpy()[codes], at) > 0
                for c in _SUMS:
                    sums[c][rows] += _sums(table.column(c).to_numpy()[codes], at)
                links, links_at = _lists(table)
                times = np.diff(links_at)[codes]
                flat_links = links[np.repeat(links_at[codes] - np.cumsum(times) + times, times) + np.arange(times.sum())]
                text_of = table.column("text").combine_chunks().take(pa.array(codes))
                text_of = text_of.combine_chunks() if isinstance(text_of, pa.ChunkedArray) else text_of
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), text_of), ";").to_pylist()
                if len(rows) > 1:
                    # a pair's ids take 16 bits each or few more: of the 64 bits, the row has the upper ones
                    owner = np.repeat(np.arange(len(rows)), _sums(times, at))
                    narrow = (flat_links >> 32) * len(aligner.sizes[1]) + (flat_links & 0xFFFFFFFF)
                    keys, counts = _sorted_counts(owner * (len(aligner.sizes[0]) * len(aligner.sizes[1])) + narrow)
                    owner, narrow = np.divmod(keys, len(aligner.sizes[0]) * len(aligner.sizes[1]))
                    pairs = narrow // len(aligner.sizes[1]) << 32 | narrow % len(aligner.sizes[1])
                    edge = np.searchsorted(owner, np.arange(len(rows) + 1))
                    for k, (row, x) in enumerate(zip(rows.tolist(), joined, strict=True)):
                        told[row] = hashlib.sha256(x.encode()).hexdigest() if digest else x
                        linked[row] = _packed(pairs[edge[k] : edge[k + 1]], counts[edge[k] : edge[k + 1]])
                else:  # perhaps one part of several
                    x = ";" * bool(part) + joined[0]
                    state.update(x.encode())
                    held.append(_sorted_counts(flat_links))
                    if not digest:
                        pieces.append(x)
                    told[rows[0]] = state.hexdigest() if digest else "".join(pieces)
            if held:
                linked[rows[0]] = _packed(*_sorted_counts(*(np.concatenate(x) for x in zip(*held, strict=True))))
            for k in np.flatnonzero(broken | (sums["n_a"] == 0)).tolist():
                told[k], linked[k] = "", b""
            for x in sums.values():
                x[broken] = 0
            own = batch.select([f.name for f in kept])
            columns = [*own.columns, *(pa.array(sums[c]) for c in _SUMS), pa.array(told, pa.string()), pa.array(task + made + np.arange(size)), pa.array(linked, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*own.schema.names, *_SUMS, "__groups", "__row", "__links"])
            made += size

    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{c} long" for c in _SUMS), "__groups string, __row long, __links binary"]
    return docs.mapInArrow(run, ", ".join(fields))


def _pair_counts(coded: DataFrame) -> DataFrame:
    def run(batches):
        held, size = [], 0

        def given():
            pairs, counts = _sorted_counts(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])

        for batch in batches:
            for packed in batch.column("__links"):
                if packed.is_valid and len(packed.as_buffer()):
                    held.append(_unpacked(packed.as_py()))
                    size += len(held[-1][0])
                if size > 2 * PAIRS:
                    one = given()
                    held, size = [(one.column(0).to_numpy(), one.column(1).to_numpy())], one.num_rows
                    if size > PAIRS:
                        yield one
                        held, size = [], 0
        if held:
            yield given()

    return coded.select("__links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, a: str, b: str, text: str = "text") -> DataFrame:
    """(pair, n): how often an A and a B token with these ids overlap in the corpus; pair is a << 32 | b.

    Null and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens; repeated rows count each time; an
    empty table has no pairs."""
    return _pair_counts(_coded(docs.select(text), a, b, text, True))


def align(docs: DataFrame, a: str, b: str, text: str = "text", digest: bool = True, hot: int = HOT) -> DataFrame:
    """docs without the text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (``digest=False``: the text ``groups`` itself).

    A group is written as its A ids, "|" and its B ids, each joined by ","; groups are joined by ";". A link's count is how often its
    pair of ids is linked in the corpus; n_best counts links whose count is the highest of their B id, ties included.
    Null and empty texts, and texts that either tokenizer does not give back byte by byte (one with U+2581), have zeros and '' ; repeated
    rows stay; an empty table gives an empty one. A text of any length is taken in parts at spaces; a stretch without a single space is one
    unit, which takes some 150 times its bytes while it is encoded. An input column named like an added one raises ValueError.
    """
    names = [*_SUMS, "n_best", "count_sum", "groups_sha256" if digest else "groups"]
    if both := {*names, "__row", "__far", "__links", "__groups", "__sum", "__best"} & set(docs.columns):
        raise ValueError(f"rename these input columns first: {sorted(both)}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    coded = scratch.save(_coded(docs, a, b, text, digest), "coded")
    counts = scratch.save(_pair_counts(coded), "pairs")
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    best = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))  # a row for each entry of B's vocabulary at most
    known = scratch.save(counts.withColumn("b", b_id).join(best, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")
    scratch.drop(counts)
    edge = WordTable._edges(known, hot)[0]
    frequent = known.where(F.col("n") >= edge).toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast(tuple(frequent.column(c).to_numpy() for c in ("pair", "n", "best")))
    del frequent
    scratch.release()
    kept = [f for f in coded.schema.fields if f.name != "__links"]

    def run(batches):
        pairs, n, best = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                lists = [_unpacked(x) for x in part.column("__links").to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x, _ in lists])]).astype(np.int64)
                own, times = (np.concatenate([x[k] for x in lists]) for k in (0, 1))
                place = np.minimum(np.searchsorted(pairs, own), max(0, len(pairs) - 1))
                hit = pairs[place] == own if len(pairs) else np.zeros(len(own), bool)
                of = lambda x: _sums(np.where(hit, times * x[place], 0), ends) if len(x) else np.zeros(len(lists), np.int64)  # noqa: B023, E731
                left = np.concatenate([[0], np.cumsum(~hit)])[ends]
                far = pa.StructArray.from_arrays([pa.array(own[~hit], pa.int64()), pa.array(times[~hit], pa.int64())], ["pair", "times"])
                out = part.select([f.name for f in kept])
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(of(best)), pa.array(of(n)), pa.ListArray.from_arrays(pa.array(left, pa.int32()), far)], [*out.schema.names, "__best", "__sum", "__far"])

    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "__best long, __sum long, __far array<struct<pair:long,times:long>>"]
    summed = scratch.save(coded.mapInArrow(run, ", ".join(fields)), "sums")
    scratch.drop(coded)
    # the pairs that are not in each task: none of them holds more than 1 / hot of all links
    far = summed.select("__row", F.explode("__far").alias("far")).select("__row", "far.*")
    met = far.join(known.where(F.col("n") < edge), "pair")
    added = met.groupBy("__row").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("better"))
    out = summed.drop("__far").join(added.withColumnRenamed("__row", "__of"), F.col("__row") == F.col("__of"), "left")
    own = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name != text]
    return out.select(*own, *_SUMS, (F.col("__best") + F.coalesce("better", F.lit(0))).alias("n_best"), (F.col("__sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), F.col("__groups").alias(names[6]))
