"""Byte ranges of blobs, and envelope signatures, over local sockets.

Frames are JSON with a length of four bytes, most significant first, before them.
"""

from __future__ import annotations

import io
import json
import socket
import struct
import uuid

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import BlobAccessDenied, BlobError, BlobRangeError, SigningRefused

#: Fixed values of the protocols: operation codes, and the largest answers in bytes.
READ, STAT, SIGN = "0x30", "0x31", "0x42"
MOST_HEADER, MOST_STAT, MOST_SIGNED = 4 * 1024 * 1024, 64 * 1024, 1024 * 1024


def _exactly(s: socket.socket, n: int) -> bytes:
    out = bytearray()
    while len(out) < n:
        part = s.recv(min(n - len(out), 1 << 20))
        if not part:
            raise BlobError("the service closed the connection early")
        out += part
    return bytes(out)


def _ask(path: str, request: dict, most: int, timeout_s: float) -> tuple[dict, socket.socket]:
    s = socket.socket(socket.AF_UNIX, socket.SOCK_STREAM)
    s.settimeout(timeout_s)
    try:
        s.connect(path)
        body = json.dumps(request).encode()
        s.sendall(struct.pack(">I", len(body)) + body)
        size = struct.unpack(">I", _exactly(s, 4))[0]
        if not 0 < size <= most:
            raise BlobError(f"an answer of {size} bytes; 1 to {most} are allowed")
        answer = json.loads(_exactly(s, size))
    except OSError as e:
        s.close()
        raise BlobError(f"the service at '{path}' failed: {e}") from None
    except ValueError as e:
        s.close()
        raise BlobError(f"the answer is no JSON: {e}") from None
    except BlobError:
        s.close()
        raise
    return answer, s


def _checked(answer: dict) -> dict:
    if answer.get("error"):
        kind = {"ACCESS_DENIED": BlobAccessDenied, "RANGE_ERROR": BlobRangeError}.get(answer.get("error_code"), BlobError)
        raise kind(f"{answer.get('error_code') or 'UNKNOWN'}: {answer['error']}")
    return answer


class BlobClient:
    """Reads of one asset at a time for a tenant and a token."""

    def __init__(self, socket_path: str, tenant_id: str = "", token: str = "", timeout_s: float = 30.0):
        self.path, self.tenant_id, self.token, self.timeout_s = socket_path, tenant_id, token, timeout_s

    def _request(self, code: str, asset_id: str, **more) -> dict:
        return {"opcode": code, "asset_id": asset_id, **more, "tenant_id": self.tenant_id, "principal_jwt": self.token}

    def stat(self, asset_id: str) -> dict:
        answer, s = _ask(self.path, self._request(STAT, asset_id), MOST_STAT, self.timeout_s)
        s.close()
        return _checked(answer)

    def read(self, asset_id: str, offset: int, length: int) -> bytes:
        answer, s = _ask(self.path, self._request(READ, asset_id, offset=offset, length=length), MOST_HEADER, self.timeout_s)
        with s:
            count = _checked(answer).get("byte_count")
            return _exactly(s, length if count is None else count)

    def get_range(self, asset_id: str, start: int | None = None, stop: int | None = None) -> bytes:
        """Like a slice: bounded, from an offset on, or (negative start) the last bytes."""
        if start is not None and stop is not None and start >= 0 and stop >= 0:
            return self.read(asset_id, start, max(stop - start, 0))
        size = int(self.stat(asset_id)["size"])
        a, b, _ = slice(start, stop).indices(size)
        return self.read(asset_id, a, max(b - a, 0))


class BlobStore:
    """The service as a read-only object store: paths are assets, nothing is listed, and writing is refused."""

    def __init__(self, client: BlobClient):
        self._client = client

    def head(self, path: str) -> int:
        """The object's size."""
        return int(self._client.stat(path)["size"])

    def get(self, path: str) -> bytes:
        return self._client.get_range(path)

    def get_range(self, path: str, start: int | None = None, stop: int | None = None) -> bytes:
        return self._client.get_range(path, start, stop)

    def list(self, prefix: str = "") -> list[str]:
        return []

    def put(self, path: str, data: bytes) -> None:
        raise BlobError("the store is read-only")

    def delete(self, path: str) -> None:
        raise BlobError("the store is read-only")


class SocketSigner:
    """Signs attestation envelopes through a signing service."""

    def __init__(self, socket_path: str, timeout_s: float = 30.0):
        self.path, self.timeout_s = socket_path, timeout_s
        self.key_id: str | None = None

    def sign(self, envelope_json: str, engine_version: str, tenant_id: str) -> str:
        request = {"opcode": SIGN, "envelope_json": envelope_json, "engine_version": engine_version, "tenant_id": tenant_id, "correlation_id": str(uuid.uuid4())}
        answer, s = _ask(self.path, request, MOST_SIGNED, self.timeout_s)
        s.close()
        if not answer.get("jws"):
            raise SigningRefused(str(answer.get("error") or "no signature came"))
        self.key_id = answer.get("kid")
        return answer["jws"]


class _Slice(InputPartition):
    def __init__(self, offset: int, length: int):
        self.offset, self.length = offset, length


class BlobSource(DataSource):
    """``spark.read.format("pact_blob")``: the bytes of an asset in slices, read by the executors.

    Options: socket, asset, tenant, token, slice (bytes, 8 MiB if not given).
    """

    @classmethod
    def name(cls) -> str:
        return "pact_blob"

    def schema(self) -> str:
        return "offset long, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _BlobReader(dict(self.options))


class _BlobReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def _client(self) -> BlobClient:
        return BlobClient(self.options["socket"], self.options.get("tenant", ""), self.options.get("token", ""))

    def partitions(self):
        size, step = int(self._client().stat(self.options["asset"])["size"]), int(self.options.get("slice", 8 << 20))
        return [_Slice(k, min(step, size - k)) for k in range(0, size, step)] or [_Slice(0, 0)]

    def read(self, partition: _Slice):
        if partition.length:
            yield partition.offset, self._client().read(self.options["asset"], partition.offset, partition.length)


class BlobFile(io.RawIOBase):
    """A seekable, read-only file over byte ranges of an asset. Writing is not supported."""

    def __init__(self, client: BlobClient, asset_id: str):
        self._client, self._asset = client, asset_id
        self._size, self._at = int(client.stat(asset_id)["size"]), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = 0) -> int:
        self._at = max(0, offset + (0, self._at, self._size)[whence])
        return self._at

    def readinto(self, into) -> int:
        data = self.read(len(into))
        into[: len(data)] = data
        return len(data)

    def read(self, n: int = -1) -> bytes:
        n = max(0, min(self._size - self._at, n if n is not None and n >= 0 else self._size))
        data = self._client.read(self._asset, self._at, n) if n else b""
        self._at += len(data)
        return data


class _RowGroup(InputPartition):
    def __init__(self, number: int):
        self.number = number


class BlobTable(DataSource):
    """``spark.read.format("pact_blob_table")``: a Parquet table held as an asset, a partition for each row group.

    Options as for pact_blob. Comparisons of columns with values are pushed down
    to skip row groups by their statistics; Spark applies them again to the rows.
    Sources in Python aren't told which columns a query needs: the option ``columns``
    (names with commas between them) limits the table, and what is read, to some.
    """

    @classmethod
    def name(cls) -> str:
        return "pact_blob_table"

    def schema(self):
        import pyarrow as pa
        from pyspark.sql.pandas.types import from_arrow_schema

        found, names = _table(dict(self.options)).schema_arrow, _columns(dict(self.options))
        return from_arrow_schema(found if names is None else pa.schema([found.field(n) for n in names]))

    def reader(self, schema) -> DataSourceReader:
        return _BlobTableReader(dict(self.options))


def _columns(options: dict) -> list[str] | None:
    return [c.strip() for c in options["columns"].split(",")] if options.get("columns") else None


def _table(options: dict):
    import pyarrow as pa
    import pyarrow.parquet as pq

    client = BlobClient(options["socket"], options.get("tenant", ""), options.get("token", ""))
    return pq.ParquetFile(pa.PythonFile(BlobFile(client, options["asset"]), mode="r"))


class _BlobTableReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.bounds: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            kind = type(f).__name__
            if kind in ("EqualTo", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual") and len(f.attribute) == 1:
                self.bounds.append((f.attribute[0], kind, f.value))
        return filters

    def _may_hold(self, group) -> bool:
        columns = {group.column(k).path_in_schema: group.column(k).statistics for k in range(group.num_columns)}
        for name, kind, value in self.bounds:
            s = columns.get(name)
            if s is None or not s.has_min_max:
                continue
            try:
                if kind in ("EqualTo", "GreaterThan", "GreaterThanOrEqual") and (s.max < value or kind == "GreaterThan" and s.max == value):
                    return False
                if kind in ("EqualTo", "LessThan", "LessThanOrEqual") and (s.min > value or kind == "LessThan" and s.min == value):
                    return False
            except TypeError:
                continue
        return True

    def partitions(self):
        meta = _table(self.options).metadata
        return [_RowGroup(k) for k in range(meta.num_row_groups) if self._may_hold(meta.row_group(k))]

    def read(self, partition: _RowGroup):
        yield from _table(self.options).iter_batches(row_groups=[partition.number], columns=_columns(self.options))
