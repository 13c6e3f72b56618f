"""WARC archives: segmented writing, and reading back by segment reassembly.

Writing: a payload's HTTP message (chunked transfer framing) becomes one record,
or, beyond ``segment_bytes``, a first record and continuation records; each record
is a gzip member of its own. Spark's text writer puts them into files, so any
Hadoop store will do: its line end is an empty gzip member, at which large archives
are split among tasks again when they are read.

Reading: records of every archive are parsed by their Content-Length, segments are
grouped by the origin's identifier, ordered by segment number and streamed through
a length check and a decoder of the chunked framing; no payload is held whole
unless it is asked for. Revisits are held against the record they refer to.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, released, save, small_batches

SEGMENT_BYTES = 16 * 1024
CHUNK_BYTES = 4 * 1024
REVISIT_FROM = 1000  # payloads below this many bytes are always written in full
FILE_ROWS = 1000  # rows of about ROW_BYTES in one archive
ROW_BYTES = 1_000_000
#: A gzip member without content.
_EMPTY = bytes((0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 255, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0))
_END = b"\r\n\r\n"
_SPACE = uuid.UUID("6f0a3c52-3d0f-5f0e-9a44-0f6d1c9b7e21")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def _urn(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page_id))}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block


def _chunked(payload: bytes, size: int) -> bytes:
    out = [b"%x\r\n%s\r\n" % (len(c), c) for c in (payload[k : k + size] for k in range(0, len(payload), size))]
    return b"".join(out) + b"0\r\n\r\n"


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record + _END) + z.flush()


def records_of(page_id, url, html: str | None, digest: str, refers_to, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page, without the end mark."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    url = None if url is None else "".join(c for c in url if c > " ")
    revisit = refers_to is not None
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Page-ID", page_id), ("Write-ID", uuid.uuid4().hex)]
    if revisit:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to)), ("Refers-To-Page-ID", refers_to)]
        yield _record(head + more, _HTTP + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + _chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield _record(head, block)
        return
    parts = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    yield _record([*head, ("WARC-Segment-Number", 1)], parts[0])
    for n, part in enumerate(parts[1:], 2):
        last = ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", url), ("WARC-Segment-Origin-ID", head[1][1]), ("WARC-Segment-Number", n), last, head[-1]], part)


def _writer(segment_bytes: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for record in records_of(*row, segment_bytes, chunk_bytes):
                    held.append(_member(record))
                    size += len(held[-1])
                    if size >= ROW_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])

    return run


def plan_records(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """page_id, url, html, digest, refers_to: the largest page_id of equal payloads is the response."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html")).withColumn("digest", F.sha1("html"))
    large = F.octet_length("html") >= revisit_from
    first = rows.where(large).groupBy(F.col("digest").alias("of")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = save(first, "responses")  # a table of its own, so that a hot digest's partition can be split in the join
    # Rows that are written in full whatever their digest need not meet a partner.
    key = F.when(F.octet_length("html") >= revisit_from, F.col("digest")).otherwise(F.concat(F.lit("-"), F.col("page_id").cast("string")))
    joined = rows.withColumn("key", key).join(first.hint("merge"), F.col("key") == F.col("of"), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_warc(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, revisit_from: int = REVISIT_FROM) -> None:
    """Write a record for each row of ``page_id, url, html`` to ``path``; other columns are ignored.

    A null html is an empty payload. Rows that share payload and the largest
    page_id are all responses. An empty table makes an empty folder.
    """
    small_batches(pages.sparkSession)
    rows = plan_records(pages, revisit_from).mapInArrow(released(_writer(segment_bytes, chunk_bytes)), "value binary")
    writer = rows.select(F.col("value").cast("string").alias("value")).write
    writer.option("lineSep", _EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", FILE_ROWS).text(path)


DAMAGE: dict[str, str] = {"warc-type": "damage"}  # fields that stand for bytes which make no record


def parse_records(data: bytes | Iterator[bytes | None]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record, from bytes or pieces of them.

    Bytes that make no record, and a None among the pieces, give DAMAGE and an empty
    block, and reading goes on at the next record; a record that is cut short has
    the block that there is.
    """
    pieces = iter((data,)) if isinstance(data, bytes) else data
    held, at, ended, broken = b"", 0, False, False

    def more() -> bool:
        nonlocal held, at, ended, broken
        if ended or broken:
            return False
        try:
            piece = next(pieces)
        except StopIteration:
            ended = True
            return False
        if piece is None:  # what is held and what follows do not belong together
            broken = True
            return False
        held, at = held[at:] + piece, 0
        return True

    while True:
        while held.startswith(b"\r\n", at):
            at += 2
        if len(held) - at < 2 and more():
            continue
        if at == len(held):
            if broken:
                broken = False
                yield DAMAGE, b""
                continue
            if ended:
                return
        end = held.find(_END, at)
        if end < 0 and more():
            continue
        fields, length = {}, ""
        if held.startswith(b"WARC/1.", at) and end >= 0:
            lines = held[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            length = fields.get("content-length", "")
        if not (length.isascii() and length.isdigit()) or "warc-type" not in fields or "warc-record-id" not in fields:
            yield DAMAGE, b""
            while (end := held.find(b"\r\nWARC/1.", at + 1)) < 0 and more():
                pass
            if end < 0 and (ended or broken):
                held, at, broken = b"", 0, False
            else:
                at = end
            continue
        start, size = end + 4 - at, int(length)
        while len(held) - at < start + size and more():
            pass
        yield fields, held[at + start : at + start + size]
        at = min(at + start + size, len(held))


def _inflated(data: bytes) -> Iterator[bytes | None]:
    """The bytes of a gzip file, a part at a time; None where they can't be read or end too early."""
    while data:
        z = zlib.decompressobj(47)
        try:
            part = z.decompress(data, ROW_BYTES)
            while part:
                yield part
                # After the end the tail may hold what is in unused_data already.
                part = b"" if z.eof else z.decompress(z.unconsumed_tail, ROW_BYTES)
            rest = z.unused_data if z.eof else None
        except zlib.error:
            rest = None
        if rest is None:
            yield None
            following = data.find(b"\x1f\x8b\x08", 1)
            rest = data[following:] if following > 0 else b""
        data = rest


class HttpBody:
    """Takes an HTTP message piece by piece; gives the body without its chunked framing."""

    def __init__(self):
        self.head, self.rest, self.chunked, self.left, self.state = b"", b"", False, None, "head"
        self.length: int | None = None
        self.plain = 0

    def feed(self, data: bytes) -> Iterator[bytes]:
        data = self.rest + data
        self.rest = b""
        while data:
            if self.state == "head":
                end = data.find(_END)
                if end < 0:
                    self.rest = data
                    return
                self.head, data = data[:end], data[end + 4 :]
                fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(b":") for x in self.head.split(b"\r\n")[1:]))
                self.chunked = fields.get(b"transfer-encoding", b"").lower() == b"chunked"
                self.length = int(fields[b"content-length"]) if fields.get(b"content-length", b"").isdigit() else None
                self.state = "size" if self.chunked else "plain"
            elif self.state == "plain":
                self.plain += len(data)
                yield data
                return
            elif self.state == "size":
                end = data.find(b"\r\n")
                if end < 0:
                    self.rest = data
                    return
                self.left, data = int(data[:end].split(b";")[0], 16), data[end + 2 :]
                self.state = "data" if self.left else "trailer"
            elif self.state == "data":
                piece, data = data[: self.left], data[self.left :]
                self.left -= len(piece)
                yield piece
                if not self.left:
                    self.state = "mark"
            elif self.state == "mark":
                if len(data) < 2:
                    self.rest = data
                    return
                if data[:2] != b"\r\n":
                    raise ValueError("a chunk has no end mark")
                data, self.state = data[2:], "size"
            elif self.state == "trailer":
                end = data.find(b"\r\n")
                if end < 0:
                    self.rest = data
                    return
                line, data = data[:end], data[end + 2 :]
                self.state = "trailer" if line else "done"
            else:
                raise ValueError("bytes after the last chunk")

    @property
    def whole(self) -> bool:
        return self.state == "done" or self.state == "plain" and self.length in (None, self.plain)


_SEGMENT = pa.schema([("origin", pa.string()), ("write", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("target", pa.string()), ("block", pa.binary()), ("bytes", pa.int64()), ("ok", pa.bool_())])
_SEGMENT_SQL = "origin string, write string, number int, total long, type string, page_id long, url string, digest string, refers_to long, target string, block binary, bytes long, ok boolean"
_READ = ("response", "revisit", "continuation")  # of a record's first segment that is there
_WHOLE = 0  # number of a record that was decoded where it was read; its block is the payload, if that is wanted
_PAYLOAD = pa.schema([("record_id", pa.string()), ("target", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("verified", pa.bool_()), ("payload", pa.binary())])
_PAYLOAD_SQL = "record_id string, target string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, verified boolean, payload binary"


def _number(x: str | None) -> int | None:
    return int(x) if x and x.lstrip("-").isascii() and x.lstrip("-").isdigit() else None


def _segments(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _SEGMENT)], schema=_SEGMENT)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for f, block in parse_records(_inflated(content.as_py())):
                    n, kind = _number(f.get("warc-segment-number")), f["warc-type"].lower()
                    if n is None and kind not in ("response", "revisit", "damage"):
                        continue
                    record = f.get("warc-record-id", "")
                    digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    total = _number(f.get("warc-segment-total-length")) if n else _number(f.get("content-length"))
                    row = (f.get("warc-segment-origin-id", record), f.get("write-id", ""), n or 1, total, kind, _number(f.get("page-id")), f.get("warc-target-uri"), digest, _number(f.get("refers-to-page-id")), f.get("warc-refers-to"), block, None, None)
                    if kind == "damage":
                        row = (*row[:2], _WHOLE, *row[3:10], None, None, False)
                    elif n is None:
                        one = _Payload(row, keep)
                        one.add(row)
                        found = one.row()
                        row = (*row[:2], _WHOLE, None, *row[4:7], found[7], *row[8:10], found[9], found[6], found[8])
                    rows.append(row)
                    size += len(row[10] or b"") + 200
                    if size > ROW_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return run


class _Payload:
    """One record from its segments, in order."""

    def __init__(self, row: tuple, keep: bool):
        self.record, (self.type, self.page_id, self.url, self.digest, self.refers_to, self.target) = row[0], row[4:10]
        self.http, self.sha, self.bytes, self.seen, self.total, self.next, self.ok = HttpBody(), hashlib.sha1(), 0, 0, None, 1, True
        self.kept: list[bytes] | None = [] if keep else None

    def add(self, row: tuple) -> None:
        number, total, block = row[2], row[3], row[10]
        if number < self.next:  # the segment stands in several archives
            return
        self.ok &= number == self.next
        self.next = number + 1
        self.seen += len(block)
        self.total = total if total is not None else self.total
        if self.ok:
            try:
                for piece in self.http.feed(block):
                    self.sha.update(piece)
                    self.bytes += len(piece)
                    if self.kept is not None:
                        self.kept.append(piece)
            except ValueError:
                self.ok = False

    def row(self) -> tuple:
        names = self.record, self.target, self.page_id, self.url
        if self.type == "revisit":
            ok = self.ok and self.seen == self.total and self.http.length is not None
            return *names, self.type, self.refers_to, self.http.length, self.digest, ok, None
        if self.type == "continuation":  # the first segment is missing
            return None, None, None, None, "damage", None, None, None, False, None
        found = self.sha.hexdigest()
        ok = self.ok and self.http.whole and self.seen == self.total and found == self.digest
        return *names, self.type, self.refers_to, self.bytes, found, ok, b"".join(self.kept) if self.kept is not None else None


def _assembled(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, out, size = None, None, [], 0

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _PAYLOAD)], schema=_PAYLOAD)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[2] == _WHOLE:
                    out.append((row[0], row[9], row[5], row[6], row[4], row[8], row[11], row[7], row[12], row[10]))
                    size += len(row[10] or b"")
                    if len(out) >= 1000 or size > ROW_BYTES:
                        yield batch_of(out)
                        out, size = [], 0
                    continue
                if now is None or key != row[:2]:
                    if now is not None and now.type in _READ:
                        out.append(now.row())
                        size += now.bytes if keep else 0
                    key, now = row[:2], _Payload(row, keep)
                now.add(row)
                if len(out) >= 1000 or size > ROW_BYTES:
                    yield batch_of(out)
                    out, size = [], 0
        if now is not None and now.type in _READ:
            out.append(now.row())
        if out:
            yield batch_of(out)

    return run


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per response or revisit record of all archives in ``path``: those of write_warc, and files ``*.gz``.

    ``page_id, url, record_type, refers_to, payload_bytes, payload_digest,
    verified, payload``. ``verified`` is false where segments are missing, the
    total length, the body's length or the digest differ, or the framing is broken. A revisit has
    the length and digest it declares, and the payload of the record it refers to; it is verified if
    that one is there, verified, and of that length and digest. Bytes that make no record, the rest of a
    file that ends too early, and segments without a first one give a row of the type ``damage``, unverified and
    otherwise null; the other records are read. A segmented record that stands in several archives is one. Other types of records give no rows; with ``payloads``
    false no payload is returned. A file ``*.gz`` is held whole by its task.
    """
    small_batches(spark)
    own = spark.read.option("lineSep", _EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("pathGlobFilter", "*.txt").text(path).select(F.col("value").cast("binary").alias("content"))
    files = own.union(spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content"))
    segments = files.mapInArrow(released(_segments(payloads)), _SEGMENT_SQL).repartition("origin", "write")
    found = save(segments.sortWithinPartitions("origin", "write", "number").mapInArrow(released(_assembled(payloads)), _PAYLOAD_SQL), "records")
    others = found.where("record_type <> 'revisit'").drop("record_id", "target")
    target = found.where("record_type = 'response' AND verified").groupBy(F.col("record_id").alias("target"), "payload_digest", "payload_bytes").agg(F.min("payload").alias("of"), F.lit(True).alias("there"))
    # Both sides are plain shuffles of a large join, so that a record which many refer to can be split in it.
    revisits = found.where("record_type = 'revisit'").drop("payload", "record_id").join(target.hint("merge"), ["target", "payload_digest", "payload_bytes"], "left")
    revisits = revisits.withColumn("verified", F.col("verified") & F.coalesce("there", F.lit(False))).withColumnRenamed("of", "payload").drop("target", "there")
    return others.unionByName(revisits)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages to archives in the shared folder and read those back, without payloads."""
    path = new_folder(pages.sparkSession, "warc")
    write_warc(pages, path, **options)
    return read_warc(pages.sparkSession, path, payloads=False)
