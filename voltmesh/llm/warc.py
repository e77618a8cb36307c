"""WARC archives from and to a chunked record table (operator 7).

Payloads move as (record, chunk number, bytes) rows. The writer streams the chunks of a record into one gzip member and
carries its SHA-1 along; the reader inflates members bit by bit and gives chunk rows with the length and digest so far,
so neither holds a whole record. Files go to a folder that all executors share, through Arrow's file systems; an attempt writes under a
name of its own and renames at the end, so a lost or repeated task leaves whole archives only.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

CHUNK = 1 << 18
#: Equal payloads of at least so many bytes are written once.
REVISIT = 1000
#: Revisits that may be broadcast, about 70 bytes each.
FEW = 1 << 20
#: A task closes an archive beyond so many compressed bytes and opens the next.
ARCHIVE = 1 << 30
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"


def _head(page, url, digest: str, size: int, refers) -> tuple[bytes, bytes]:
    """WARC header and HTTP header of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    safe = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{'' if page is None else page}>", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {safe}"] if safe else []
    lines += ["WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()]
    lines += [] if refers is None else [f"WARC-Refers-To: <{_ID}{refers}>", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (size if refers is None else 0)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


def chunk_table(pages: DataFrame, key: str, url: str, html: str, scratch: Scratch, chunk: int = CHUNK) -> DataFrame:
    """(page, url, size, digest, refers, no, last, data): the payloads in chunks; a revisit and an empty payload have one empty chunk."""
    slim = pages.select(F.col(key).cast("long").alias("page"), F.col(url).alias("url"), F.encode(F.coalesce(html, F.lit("")), "UTF-8").alias("body"))
    slim = slim.withColumns({"size": F.length("body").cast("long"), "digest": F.sha1("body")})
    large = slim.where(F.col("size") >= REVISIT).select("page", "digest")
    tops = scratch.save(large.groupBy(F.col("digest").alias("d")).agg(F.max("page").alias("refers"), F.count("*").alias("n")).where("n > 1").select("d", "refers"), "tops")
    again = large.join(tops, F.col("digest") == F.col("d")).where("page < refers").select(F.col("page").alias("p"), "d", "refers").distinct()
    again = scratch.save(again, "revisits")
    # payloads stay where they are while the revisits can be broadcast; many more of them meet the payloads hash by hash, without a sort
    few = again.count() <= FEW
    met = (F.col("page") == F.col("p")) & (F.col("digest") == F.col("d"))
    marked = slim.join(F.broadcast(again) if few else again.hint("shuffle_hash"), met, "left").drop("p", "d")
    kept = F.when(F.col("refers").isNull(), F.col("size")).otherwise(F.lit(0))
    # one chunk of a payload at a time: the rows that explode makes share the payload, and each cuts its own piece
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(kept / chunk).cast("int") - 1))
    rows = marked.withColumn("kept", kept).select("page", "url", "size", "digest", "refers", "kept", "body", F.explode(numbers).alias("no"))
    data = F.when(F.col("refers").isNull(), F.substring("body", F.col("no") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    return rows.select("page", "url", "size", "digest", "refers", "no", data.alias("data"), ((F.col("no") + 1) * F.lit(chunk) >= F.col("kept")).alias("last"))


class _Archive:
    """An archive under way; finish() gives it its name."""

    def __init__(self, folder: str):
        self.fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        name = uuid.uuid4().hex
        self.name, self.at, self.to = f"{name}.warc.gz", f"{base}/.{name}.part", f"{base}/{name}.warc.gz"
        self.out, self.bytes, self.records = self.fs.open_output_stream(self.at), 0, 0

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def finish(self) -> dict:
        self.out.close()
        self.fs.move(self.at, self.to)
        return {"archive": self.name, "bytes": self.bytes, "records": self.records}


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", chunk: int = CHUNK) -> DataFrame:
    """Write one record for each row into .warc.gz files of ``folder`` and return the list (archive, bytes, records).

    Of rows with equal payloads of at least 1000 bytes those with the largest key are responses, the others revisit it. A
    null payload is empty; rows without a key are responses; repeated rows are records each; an empty table writes no archive. The key
    must be castable to long; columns other than the three named are not written.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]):
        archive = press = state = None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}  # one chunk at a time
                archive = archive or _Archive(folder)
                if row["no"] == 0:
                    press, state = zlib.compressobj(4, zlib.DEFLATED, 31), hashlib.sha1()
                    head, http = _head(row["page"], row["url"], row["digest"], row["size"], row["refers"])
                    archive.put(press.compress(head + http))
                state.update(row["data"])
                archive.put(press.compress(row["data"]))
                if row["last"]:
                    if row["refers"] is None and state.hexdigest() != row["digest"]:
                        raise ValueError(f"page {row['page']}: its chunks do not have the payload's digest")
                    archive.put(press.compress(b"\r\n\r\n") + press.flush())
                    archive.records += 1
                    if archive.bytes > ARCHIVE:
                        yield pa.RecordBatch.from_pylist([archive.finish()])
                        archive = None
        if archive:
            yield pa.RecordBatch.from_pylist([archive.finish()])

    made = chunk_table(pages, key, url, html, scratch, chunk).mapInArrow(run, "archive string, bytes long, records long")
    return scratch.save(made, "archives")


class _Stream:
    """Inflated bytes of an archive, taken as asked for."""

    def __init__(self, source):
        self.source, self.ahead, self.left = source, b"", b""
        self.inflate = zlib.decompressobj(31)

    def more(self) -> bool:
        while True:
            raw = self.left or self.source.read(1 << 16)
            if not raw:
                return False
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            data = self.inflate.decompress(raw, 1 << 18)
            self.left = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if data:
                self.ahead += data
                return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (at := self.ahead.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.ahead)
            if not self.more():
                return None
        got, self.ahead = self.ahead[:at], self.ahead[at + len(mark) :]
        return got

    def take(self, n: int) -> bytes:
        while len(self.ahead) < n and self.more():
            pass
        got, self.ahead = self.ahead[:n], self.ahead[n:]
        return got


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def _records(source, chunk: int, data: bool) -> Iterator[dict]:
    stream = _Stream(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = _fields(head)
        kind = fields["warc-type"]
        page, refers = (fields.get(x, "").strip("<>").removeprefix(_ID) for x in ("warc-record-id", "warc-refers-to"))
        row = {"page_id": int(page) if page else None, "record_type": kind, "refers_to": int(refers) if refers else None}
        http = stream.until(b"\r\n\r\n")
        left = int(fields["content-length"]) - len(http) - 4
        no, size, state = 0, 0, hashlib.sha1()
        while True:
            part = stream.take(min(chunk, left))
            if left and not part:
                raise ValueError(f"record {page}: the archive ends within it")
            left -= len(part)
            size += len(part)
            state.update(part)
            full = kind != "revisit"
            digest = state.hexdigest() if full else base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
            yield row | {"no": no, "data": part if data else None, "payload_bytes": size if full else int(_fields(http)["content-length"]), "payload_digest": digest, "last": not left}
            no += 1
            if not left:
                break
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError(f"record {page}: no end where its length says")


def read_archives(archives: DataFrame, folder: str, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """Chunk rows of the listed archives: page_id, record_type, refers_to, no, data, payload_bytes and payload_digest so
    far (a revisit: of the payload it stands for), last. ``data=False`` leaves the bytes out."""
    n = max(1, archives.count())

    def run(batches: Iterator[pa.RecordBatch]):
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("no", pa.int32()), ("data", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("last", pa.bool_())])
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                fs, base = pyarrow.fs.FileSystem.from_uri(folder)
                with fs.open_input_stream(f"{base}/{name}", compression=None) as source:
                    rows, held = [], 0
                    for row in _records(source, chunk, data):
                        rows.append(row)
                        held += len(row["data"] or b"") + 256
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema)

    fields = "page_id long, record_type string, refers_to long, no int, data binary, payload_bytes long, payload_digest string, last boolean"
    return archives.select("archive").repartition(n).mapInArrow(run, fields)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each row, from archives written and read back."""
    folder = Scratch(pages.sparkSession, "archives").root
    chunks = read_archives(write_archives(pages, folder, key, url, html), folder, data=False)
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
