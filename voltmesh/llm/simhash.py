"""SimHash near-duplicates through a Golay-code index (operator 9).

Fingerprints at up to two differing bits are linked. The 64 bits are three segments; two errors leave at least one of
them whole, and whichever that is, the segment that follows it in the cycle can be taken with at most one error. So a link always
shares (a whole segment, the next segment up to one bit). The second part is made exact by the perfect binary Golay
code of 23 bits: every vector has one codeword within three bits, and two vectors one bit apart meet in the codewords
of one vector and its one-bit neighbours, mostly six.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, slices

# Fixed value: a generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0xAE3
#: First bit and width of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SHINGLE, SEED = 3, 42


def _remainder(v: int) -> int:
    for bit in range(22, 10, -1):
        if v >> bit & 1:
            v ^= GENERATOR << bit - 11
    return v


class Golay:
    """codeword(v): the 12 message bits of the codeword nearest to each 23-bit vector."""

    def __init__(self):
        self.low = np.array([_remainder(v) for v in range(1 << 12)], np.int32)
        self.high = np.array([_remainder(v << 12) for v in range(1 << 11)], np.int32)
        self.error = np.zeros(1 << 11, np.int32)
        for weight in (1, 2, 3):
            for bits in combinations(range(23), weight):
                e = sum(1 << b for b in bits)
                self.error[_remainder(e)] = e

    def codeword(self, v: np.ndarray) -> np.ndarray:
        return (v ^ self.error[self.low[v & 0xFFF] ^ self.high[v >> 12]]) >> 11


def index_keys(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of fingerprints (uint64): row numbers, keys, and whether a key is the fingerprint's own codeword."""
    rows, keys, own = [], [], []
    parts = [((fps >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in SEGMENTS]
    for i in range(3):
        whole, near, width = parts[i], parts[(i + 1) % 3], SEGMENTS[(i + 1) % 3][1]
        flips = np.array([0, *(1 << b for b in range(width))], np.int64)
        found = golay.codeword((near[:, None] ^ flips[None, :]).astype(np.int32)).astype(np.int64)
        first = found[:, 0].copy()
        found.sort(axis=1)
        new = np.ones(found.shape, bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        r, c = np.nonzero(new)
        rows.append(r)
        keys.append((np.int64(i) << 40) | (whole[r] << 12) | found[r, c])
        own.append(found[r, c] == first[r])
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(own)


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _hashes(text: bytes) -> list[int]:
    words = text.translate(_LOWER).split()
    if not words:
        return []
    body = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return [digest(body, SEED)]
    return [digest(body[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False)]


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if it is set in over half of the hashes of the text's 3-word shingles."""
    lists = [_hashes(x) for x in texts]
    n = np.array([len(x) for x in lists], np.int64)
    flat = np.fromiter((h for x in lists for h in x), np.uint64, int(n.sum()))
    doc = np.repeat(np.arange(len(texts)), n)
    out = np.zeros(len(texts), np.uint64)
    for byte in range(8):
        value = ((flat >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)
        counts = np.bincount(doc * 256 + value, minlength=256 * len(texts)).reshape(len(texts), 256) @ _BITS
        on = 2 * counts > n[:, None]
        for bit in range(8):
            out |= on[:, bit].astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprints(docs: DataFrame, text: str = "text", keep: bool = False) -> DataFrame:
    """docs without the text (unless ``keep``), with ``fp`` (the fingerprint as a signed long); a text without words has 0."""
    kept = [f for f in docs.schema.fields if keep or f.name != text]

    def run(batches):
        for batch in slices(batches, text, 4 << 20):
            fp = fingerprints_of([x.encode() if x else b"" for x in batch.column(text).to_pylist()])
            own = batch.select([f.name for f in kept])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(fp.view(np.int64))], [*own.schema.names, "fp"])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "fp long"]))


def links(fps: DataFrame, most: int = 2) -> DataFrame:
    """(a, b), a < b, of the distinct fingerprints in ``fp`` that differ in 1 to ``most`` (at most 2) bits."""
    if most > 2:
        raise ValueError("the index finds up to two differing bits")

    def run(batches):
        golay = Golay()
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for start in range(0, len(fp), 20_000):
                part = fp[start : start + 20_000]
                rows, keys, own = index_keys(part.view(np.uint64), golay)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows]), pa.array(own)], ["key", "fp", "own"])

    keys = fps.select("fp").mapInArrow(run, "key long, fp long, own boolean")
    home = keys.where("own").select(F.col("key").alias("k"), F.col("fp").alias("a"))
    probe = keys.select("key", F.col("fp").alias("b"))
    near = home.join(probe, (F.col("k") == F.col("key")) & (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", most: int = 2, group: str | None = None) -> DataFrame:
    """docs without the text, with ``fp``, ``links`` (other fingerprints it links to) and ``component_id``: the smallest
    key reachable by links.

    Equal fingerprints are one node, so copies are never expanded. Null and empty texts have fingerprint 0 and link like any
    other; repeated rows share a component; null keys are never the smallest (a group of only null keys has null); an
    empty table gives an empty one; other columns stay (``fp``, ``links`` and ``component_id`` must not be among them).
    ``group`` names a column to add that tells groups apart also where their smallest keys are equal or null (the
    smallest fingerprint reachable); the text then stays.
    """
    if both := {"fp", "links", "component_id", group} & set(docs.columns):
        raise ValueError(f"rename these input columns first: {sorted(both)}")
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.save(fingerprints(docs, text, keep=group is not None), "fingerprints")
    nodes = scratch.save(marked.groupBy("fp").agg(F.min(key).alias("low")), "nodes")
    edges = scratch.save(links(nodes, most), "edges")
    found = components(edges, scratch)
    ends = edges.select(F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.count("*").alias("links"))
    labelled = nodes.join(found, F.col("fp") == F.col("id"), "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lows = labelled.groupBy(F.col("component").alias("of")).agg(F.min("low").alias("component_id"))
    classes = labelled.join(lows, F.col("component") == F.col("of")).join(ends, F.col("fp") == F.col("end"), "left")
    classes = scratch.save(classes.select(F.col("fp").alias("__fp"), F.coalesce("links", F.lit(0)).alias("links"), "component_id", *([F.col("component").alias(group)] if group else [])), "classes")
    return marked.join(classes, F.col("fp") == F.col("__fp")).drop("__fp")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
