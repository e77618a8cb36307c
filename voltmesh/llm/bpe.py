"""BPE encoding and decoding over a distinct-word table (operator 2).

Words are split in Spark tasks over whole Arrow buffers, each distinct word is encoded once, ids are joined back by
position. Decoding joins ids to the pieces of the vocabulary; the id-to-piece table is as long as the vocabulary (49,408 rows, whatever
the corpus), so each task holds it and the join is a lookup by id, without a shuffle of ids.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .scratch import Scratch, flat, strings
from .words import HOT, WordTable, row_key

# Byte classes of the pre-tokeniser: 0 white space, 1 letter, 2 digit, 3 other. Bytes from 0x80 count as letters in
# the fast path, which only sees texts whose other characters are U+00C0 to U+00FF without the two signs among them.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# The contractions of the pre-tokeniser's pattern.
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _plain(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


class WordSplitter:
    """The words that the tokenizer file's normaliser and pre-tokeniser give, without building a string for each.

    Texts of ASCII and Latin-1 letters are split over whole buffers; texts with other characters, or with what could be
    a special token, go through the library's own normaliser and pre-tokeniser. A special token found in a raw text is
    the word " " + token, which no other word can be.
    """

    def __init__(self, path: str):
        plain = _plain(path)
        special = [x["content"] for x in plain["added_tokens"]]
        # without its vocabulary: no word is encoded here
        known = Tokenizer.from_str(json.dumps(plain | {"added_tokens": [], "post_processor": None, "decoder": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}))
        self.normal, self.pre = known.normalizer, known.pre_tokenizer
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def slow(self, text: str) -> list[str]:
        out = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(f" {part}")
            elif part:
                normal = self.normal.normalize_str(part)
                out += [normal[a:b] for _, (a, b) in self.pre.pre_tokenize_str(normal)]
        return out

    def __call__(self, column: pa.Array):
        body, at = flat(column)
        before = np.concatenate([[0], body[:-1]]).astype(np.uint8) if len(body) else body
        odd = (body >= 0xC4) | (body == 0xC2) | (((body == 0x97) | (body == 0xB7)) & (before == 0xC3)) | ((body == 124) & (before == 60))
        hard = np.unique(np.searchsorted(at, np.flatnonzero(odd), side="right") - 1)
        rows = np.arange(len(at) - 1)
        if len(hard):
            texts = pc.take(column, pa.array(hard)).to_pylist()
            words = [self.slow(x) for x in texts]
            yield hard, pa.array([w for x in words for w in x], pa.large_string()), np.array([len(x) for x in words])
            easy = np.ones(len(rows), bool)
            easy[hard] = False
            rows = rows[easy]
            if not len(rows):
                return
            body, at = flat(pc.take(column, pa.array(rows)))
            before = np.concatenate([[0], body[:-1]]).astype(np.uint8) if len(body) else body
        yield rows, *self.fast(body, at, before)

    @staticmethod
    def fast(body: np.ndarray, at: np.ndarray, before: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        low = _LOWER[body]
        low[(before == 0xC3) & (low >= 0x80) & (low <= 0x9E)] += 32
        kind = _CLASS[low]
        last = np.concatenate([[0], kind[:-1]]).astype(np.uint8) if len(kind) else kind
        last[at[:-1][at[:-1] < len(body)]] = 0
        start = (kind != 0) & ((kind != last) | (kind == 2))
        room = np.concatenate([low, np.zeros(3, np.uint8)])
        end = np.append(at[1:], len(body))
        for i in np.flatnonzero(start & (low == 39)):  # an apostrophe that opens a run of signs
            stop = end[np.searchsorted(at, i, side="right") - 1]
            for x in _CONTRACTIONS:
                if i + 1 + len(x) <= stop and room[i + 1 : i + 1 + len(x)].tobytes() == x.encode():
                    start[i + 1] = False
                    if i + 1 + len(x) < stop and kind[i + 1 + len(x)]:
                        start[i + 1 + len(x)] = True
                    break
        solid = kind != 0
        place = np.concatenate([[0], np.cumsum(solid)])
        begin = np.flatnonzero(start)
        counts = np.diff(np.searchsorted(begin, at))
        return strings(low[solid], np.append(place[begin], place[-1])), counts


def word_encoder(path: str):
    """words -> array<int> column of their ids; a word is one pre-token as it stands."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
    plain = _plain(path)
    special = {f" {x['content']}": [x["id"]] for x in plain["added_tokens"]}
    plain |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
    model = Tokenizer.from_str(json.dumps(plain))

    def encode(words: list[str]) -> pa.Array:
        got = []
        for start in range(0, len(words), 1000):  # an encoding is far larger than its ids
            some = words[start : start + 1000]
            got += [special.get(w) or e.ids for w, e in zip(some, model.encode_batch(some, add_special_tokens=False), strict=True)]
        return pa.array(got, pa.list_(pa.int32()))

    return encode


def pieces(path: str) -> pa.Array:
    """The piece of each id: one row for each entry of the vocabulary, so its size is that of the tokenizer."""
    plain = _plain(path)
    found = {i: p for p, i in plain["model"]["vocab"].items()} | {x["id"]: x["content"] for x in plain["added_tokens"]}
    return pa.array([found.get(i) for i in range(max(found) + 1)], pa.string())


def _join(ids: np.ndarray, ends: np.ndarray, table: pa.Array) -> pa.Array:
    """Texts of lists of ids: each id meets its piece, pieces are joined by a space as the library does without a decoder."""
    found = table.take(pa.array(ids))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found), " ")


def _spread(codes: np.ndarray, ends: np.ndarray, values: pa.ListArray, rest: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole rows: ``codes`` point into ``values``; each -1 takes the next list of its row's ``rest``."""
    far = [x for row in rest for x in row]
    both = pa.concat_arrays([values, pa.array(far, pa.list_(pa.int32()))])
    place = codes.astype(np.int64)
    place[codes < 0] = len(values) + np.arange(len(far))
    got = both.take(pa.array(place))
    sizes = np.diff(got.offsets.to_numpy())
    reach = np.concatenate([[0], np.cumsum(sizes)])
    ids = got.flatten().to_numpy(zero_copy_only=False).astype(np.int32) if len(place) else np.zeros(0, np.int32)
    return ids, reach[ends]


def _planes(codes: np.ndarray) -> bytes:
    """Codes (-1 up to 2^24 - 2) as three planes of bytes, which compress better than whole integers."""
    return np.ascontiguousarray((codes + 1).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes()


def _codes(planes: bytes) -> np.ndarray:
    low, mid, high = np.frombuffer(planes, np.uint8).reshape(3, -1).astype(np.int32)
    return (low | mid << 8 | high << 16) - 1


def _encode(docs: DataFrame, path: str, text: str, hot: int, finish, schema: str) -> DataFrame:
    """docs' columns but the text, and what ``finish(ids, ends) -> arrays`` makes of the ids."""
    scratch = Scratch(docs.sparkSession, "bpe")
    words = WordTable(docs, text, lambda: WordSplitter(path), lambda: word_encoder(path), "array<int>", scratch, hot)
    # the key names equal rows; repeated rows share a key and so the lists of their other words
    source = docs.select("*", row_key(docs).alias("__key"))

    def emit(codes, ends, values):
        press = zstandard.ZstdCompressor(level=3).compress
        return [pa.array([press(_planes(codes[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())]

    coded = words.coded(source, emit, "codes binary")
    rest = words.far(source, "__key").repartition("__key").groupBy("__key").agg(F.sort_array(F.collect_set(F.struct("pos", "value"))).alias("far"))
    # dealt by key also where the rest is small or empty: without a shuffle between them coding and assembly are one task, which takes two Python workers
    joined = coded.drop("rest").repartition("__key").join(rest.withColumnRenamed("__key", "__far"), F.col("__key") == F.col("__far"), "left")
    joined = joined.withColumn("far", F.transform("far", lambda x: x["value"])).drop("__key", "__far")
    kept = [f for f in docs.schema.fields if f.name != text]
    shared, name = words.shared, words.name

    def assemble(batches):
        from .words import _table

        values = _table(shared, name).column("value")
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        done = finish()
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                lists = [_codes(zstandard.ZstdDecompressor().decompress(x)) for x in part.column("codes").to_pylist()]
                codes = np.concatenate(lists)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
                ids, ends = _spread(codes, ends, values, [x or [] for x in part.column("far").to_pylist()])
                own = part.select([f.name for f in kept])
                made = done(ids, ends)
                yield pa.RecordBatch.from_arrays([*own.columns, *made], [*own.schema.names, *names])

    names = [x.split()[0] for x in schema.split(",")]
    return joined.mapInArrow(assemble, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), schema]))


def encode(docs: DataFrame, path: str, text: str = "text", hot: int = HOT) -> DataFrame:
    """docs without the text, with ``ids`` (array<int>): as the tokenizer file's library encodes the whole text, without
    added special tokens. Null and empty texts have no ids; repeated rows stay; an empty table gives an empty one.
    An input column named ``ids``, ``codes``, ``rest`` or ``far`` must be renamed first (ValueError).
    """
    _clash(docs, {"ids", "codes", "rest", "far"})

    def finish():
        return lambda ids, ends: [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))]

    return _encode(docs, path, text, hot, finish, "ids array<int>")


def decode(coded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """coded with ``decoded``: the pieces of the ids joined by spaces. Null lists and null ids in them count as absent;
    an id outside the vocabulary raises."""
    _clash(coded, {"decoded"})
    shared = coded.sparkSession.sparkContext.broadcast(pieces(path).to_pylist())

    def run(batches):
        table = pa.array(shared.value, pa.string())
        for batch in batches:
            lists = batch.column(ids).cast(pa.list_(pa.int32())).fill_null([]).to_pylist()
            lists = [[x for x in row if x is not None] for row in lists]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            text = _join(np.array([x for row in lists for x in row], np.int32), ends, table)
            yield pa.RecordBatch.from_arrays([*batch.columns, text.cast(pa.string())], [*batch.schema.names, "decoded"])

    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields), "decoded string"]
    return coded.mapInArrow(run, ", ".join(fields))


def digests(docs: DataFrame, path: str, text: str = "text", hot: int = HOT) -> DataFrame:
    """docs without the text, with n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and
    decoded_sha256 (of the decoded text): encode and decode in one pass over the ids, for audits of whole corpora.

    Null and empty texts have no ids and decode to an empty text; repeated rows stay; an empty table gives an empty one; an input
    column named like an added one (or ``codes``, ``rest``, ``far``) raises ValueError."""
    _clash(docs, {"n_tokens", "ids_sha256", "decoded_sha256", "codes", "rest", "far"})

    def finish():
        table = pieces(path)

        def made(ids, ends):
            raw = ids.astype("<u4").tobytes()
            back = _join(ids, ends, table)
            spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            data, at = flat(back)
            data, at = data.tobytes(), at.tolist()
            return [
                pa.array(np.diff(ends), pa.int64()),
                pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in spans]),
                pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]),
            ]

        return made

    return _encode(docs, path, text, hot, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _clash(df: DataFrame, names: set[str]) -> None:
    if both := names & set(df.columns):
        raise ValueError(f"rename these input columns first: {sorted(both)}")
