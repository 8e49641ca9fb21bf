"""WARC records in ZIP packages, read by range.

A package is a ZIP archive of stored (not compressed) members: ``archive/data.warc.gz``
holds the records, each a gzip member of its own, and ``indexes/index.cdxj`` a line for
each with its offset and length there.  ``open_package`` reads the end record, the ZIP64
end record where sizes or counts ask for it, and the central directory;
``read_records`` then takes records by ranges of the package file, without extraction.

Paths are URIs of any file system that pyarrow reaches (file, hdfs, s3, gs).

Null html is an empty payload.  A null url has no target in its record and is read back
as null; white space within a url goes.  Null ids are kept.  Rows with equal ids are
records of their own.  Pages of any length are one record.  Of the pages' other columns
none is written, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Members above this get ZIP64 fields.
ZIP32 = 0xFFFFFFFF
#: A package is closed beyond so many bytes of records.
PACKAGE_BYTES = 64 << 20


def open_uri(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


# -- writing ---------------------------------------------------------------


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit one that keeps the HTTP header only."""
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    ident = "" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{ident}>", "WARC-Date: 1970-01-01T00:00:00Z", *([] if url is None else ["WARC-Target-URI: " + "".join(url.split())]), f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gz(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class PackageWriter:
    """Writes stored members one after another; sizes and CRC follow each in a data descriptor."""

    def __init__(self, out, zip64_from: int = ZIP32):
        self.out, self.at, self.members, self.limit = out, 0, [], zip64_from

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.open = [raw, self.at, 0, 0]
        # flag 8: a data descriptor follows; an empty ZIP64 field makes its sizes 8 bytes wide
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 0, 0, 0x21, 0, ZIP32, ZIP32, len(raw), len(extra)) + raw + extra)

    def add(self, data: bytes) -> None:
        self.open[2] += len(data)
        self.open[3] = zlib.crc32(data, self.open[3])
        self._put(data)

    def finish(self) -> None:
        raw, start, size, crc = self.open
        self._put(struct.pack("<IIQQ", 0x08074B50, crc, size, size))
        self.members.append((raw, start, size, crc))

    def close(self) -> None:
        begin = self.at
        for raw, start, size, crc in self.members:
            wide = [x for x in (size, size, start) if x >= self.limit]
            extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            s, o = (ZIP32 if size >= self.limit else size), (ZIP32 if start >= self.limit else start)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 0, 0, 0x21, crc, s, s, len(raw), len(extra), 0, 0, 0, 0, o) + raw + extra)
        size, n = self.at - begin, len(self.members)
        if begin >= self.limit or size >= self.limit or n >= 0xFFFF:
            end = self.at
            self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, begin))
            self._put(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), ZIP32 if size >= self.limit else size, ZIP32 if begin >= self.limit else begin, 0))


# -- reading ---------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    start: int
    size: int
    crc: int


def _range(f: BinaryIO, at: int, n: int) -> bytes:
    f.seek(at)
    got = f.read(n)
    if len(got) != n:
        raise ValueError(f"package ends within a range: {n} bytes at {at}")
    return got


def open_package(f: BinaryIO, length: int) -> dict[str, Member]:
    """The members in the central directory, with the offset of their data."""
    tail = min(length, 65557)
    end = _range(f, length - tail, tail)
    k = end.rfind(b"PK\x05\x06")
    if k < 0:
        raise ValueError("no end record: not a ZIP package")
    n, size, begin = struct.unpack_from("<HII", end, k + 10)
    where = length - tail + k
    if (n == 0xFFFF or ZIP32 in (size, begin)) and where >= 20:
        sig, _, at, _ = struct.unpack("<IIQI", _range(f, where - 20, 20))
        if sig == 0x07064B50:
            n, size, begin = struct.unpack_from("<QQQ", _range(f, at, 56), 32)
    found, d, p = {}, _range(f, begin, size), 0
    for _ in range(n):
        sig, _, _, _, method, _, _, crc, packed, full, ln, le, lc, _, _, _, start = struct.unpack_from("<IHHHHHHIIIHHHHHII", d, p)
        if sig != 0x02014B50:
            raise ValueError("central directory is broken")
        name, extra = d[p + 46 : p + 46 + ln].decode(), d[p + 46 + ln : p + 46 + ln + le]
        p += 46 + ln + le + lc
        while len(extra) >= 4:
            tag, n_bytes = struct.unpack_from("<HH", extra)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{n_bytes // 8}Q", extra, 4))
                full = next(wide) if full == ZIP32 else full
                packed = next(wide) if packed == ZIP32 else packed
                start = next(wide) if start == ZIP32 else start
            extra = extra[4 + n_bytes :]
        # the local header repeats the name; its extra field can be of another length
        sig, l_name, l_extra = struct.unpack("<I22xHH", _range(f, start, 30))
        if sig != 0x04034B50:
            raise ValueError(f"no local header for {name}")
        found[name] = Member(name, method, start + 30 + l_name + l_extra, full, crc)
    return found


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def read_index(f: BinaryIO, members: dict[str, Member]) -> Iterator[dict]:
    m = members[INDEX]
    if m.method:
        raise ValueError("the index isn't stored")
    at, left, rest = m.start, m.size, b""
    while left:
        n = min(left, 1 << 20)
        lines = (rest + _range(f, at, n)).split(b"\n")
        at, left, rest = at + n, left - n, lines.pop()
        for x in lines:
            yield json.loads(x.split(b" ", 2)[2])


def read_records(f: BinaryIO, length: int) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    members = open_package(f, length)
    data = members[DATA]
    if data.method:
        raise ValueError("the archive isn't stored")
    for x in read_index(f, members):
        raw = _range(f, data.start + int(x["offset"]), int(x["length"]))
        yield parse_record(zlib.decompress(raw, 31))


# -- Spark -----------------------------------------------------------------


def with_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = 0, **more: str) -> DataFrame:
    """(id, more names for columns, payload, sha, refers_to, revisit): of equal payloads of least bytes or more, rows with the largest id are responses."""
    df = pages.select(F.col(id_col).alias("id"), F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b"")).alias("payload"), *[F.col(c).alias(n) for n, c in more.items()])
    df = df.withColumn("sha", F.sha1("payload"))
    best = df.select("sha", F.octet_length("payload").alias("n"), "id").where(F.col("n") >= least).groupBy("sha").agg(F.max("id").alias("best"), F.count(F.lit(1)).alias("k"))
    best = best.where("k > 1 and best is not null").select(F.col("sha").alias("same"), "best")
    other = F.col("best").isNotNull() & ~F.col("id").eqNullSafe(F.col("best"))
    return df.join(best, F.col("sha") == F.col("same"), "left").select("id", *more, "payload", "sha", F.when(other, F.col("best")).alias("refers_to"), other.alias("revisit"))


def write_packages(pages: DataFrame, to: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write packages under to and return their manifest (path, bytes, records).

    Each attempt of a task writes files with names of its own, and the manifest is
    committed by Spark, so a retried task leaves files that nothing refers to.
    """
    rows = with_revisits(pages, id_col, html_col, least, url=url_col).select(F.col("id").cast("long").alias("id"), "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), F.octet_length("payload").cast("long").alias("size"), "sha", F.col("refers_to").cast("long").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_uri(to)
        kinds = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
        w, uri, index = None, "", []

        def shut() -> pa.RecordBatch:
            w.finish()
            w.begin(INDEX)
            for line in index:
                w.add(line)
            w.finish()
            w.close()
            w.out.close()
            return pa.RecordBatch.from_pydict({"path": [uri], "bytes": [w.at], "records": [len(index)]}, schema=kinds)

        for b in batches:
            for id_, url, body, size, sha, ref in zip(*(b.column(n).to_pylist() for n in ("id", "url", "payload", "size", "sha", "refers_to")), strict=True):
                if w is None:
                    name, index = f"{uuid.uuid4().hex}.wacz", []
                    uri = f"{to.rstrip('/')}/{name}"
                    files.create_dir(root, recursive=True)
                    w = PackageWriter(files.open_output_stream(f"{root}/{name}"))
                    w.begin(DATA)
                sha = base64.b32encode(bytes.fromhex(sha)).decode()
                gz = _gz(record(id_, url, body, size, sha, ref))
                index.append(b"page 19700101000000 " + json.dumps({"offset": str(w.open[2]), "length": str(len(gz)), "digest": sha}).encode() + b"\n")
                w.add(gz)
                if w.open[2] >= package_bytes:
                    yield shut()
                    w = None
        if w is not None:
            yield shut()

    at = f"{to.rstrip('/')}-manifest"
    rows.mapInArrow(run, "path string, bytes long, records long").write.parquet(at)
    return pages.sparkSession.read.schema("path string, bytes long, records long").parquet(at)


def read_packages(manifest: DataFrame, batch: int = 256, with_payload: bool = True) -> DataFrame:
    """A row for each record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for revisits)."""
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def number(urn: str) -> int | None:
        tail = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(tail) if tail else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, length in zip(b.column("path").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                files, at = open_uri(path)
                rows = []
                with files.open_input_file(at) as f:
                    for h, http, payload in read_records(f, length):
                        kind, sha = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:")
                        size = int(http.decode().lower().partition("content-length:")[2].split("\r\n")[0])
                        if kind == "response" and (digest(payload) != sha or len(payload) != size):
                            raise ValueError(f"payload of {h['warc-record-id']} in {path} isn't what its header says")
                        rows.append({"page_id": number(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": kind, "refers_to": number(h["warc-refers-to"]) if kind == "revisit" else None, "payload_bytes": size, "payload_digest": sha, "payload": payload if with_payload and kind == "response" else None})
                        if len(rows) == batch:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    # a package is a task's work; dealt in turn, as a hash of the path would give some tasks several
    return manifest.repartition(max(1, manifest.count())).mapInArrow(run, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, with_payload: bool = True) -> DataFrame:
    """Write pages to packages in the shared folder and read them back."""
    return read_packages(write_packages(pages, shared_path(pages.sparkSession, "warc"), id_col, url_col, html_col, least), with_payload=with_payload)
