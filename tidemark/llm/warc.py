"""WARC records in ZIP packages: a writer, and a reader that finds records by the package's directories and indexes.

A package is a ZIP file of stored members: archive/data.warc.gz, one gzip member a record, and indexes/index.cdxj, a line a
record with its offset and length. Tasks write packages as files into a folder that all share, on any file system that Arrow opens by its address. The reader opens
a file for random access, parses the end record, the ZIP64 locator and end record, and the central
directory (with ZIP64 fields), goes to the stored members by their local headers, streams the index and reads each record by its range;
nothing is extracted, and what a task holds is a record and a piece of an index, however large the file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table, shared_dir, slices
from .components import hot_keys, spread_join

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Compressed bytes, or records, after which a package is closed.
PACKAGE_BYTES, PACKAGE_RECORDS = 64 << 20, 50_000
#: Fixed values of the formats.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


# ---- writing


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_uri(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(refers_to)}"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Package:
    """A package in the making, written as it grows; only its index lines are held."""

    def __init__(self, folder: str):
        store, at = fs.FileSystem.from_uri(folder)
        name = f"{uuid.uuid4().hex}.wacz"  # a task that runs twice writes two files; the table of addresses has one of them
        self.path, self.size, self.lines = f"{folder}/{name}", 0, []
        self.out = store.open_output_stream(f"{at}/{name}")
        self.zip = zipfile.ZipFile(_Written(self.out), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)

    def add(self, url: str | None, digest: str, data: bytes) -> None:
        packer = zlib.compressobj(5, zlib.DEFLATED, 31)
        part = packer.compress(data) + packer.flush()
        entry = {"url": url or "", "digest": f"sha1:{digest}", "offset": self.size, "length": len(part), "filename": "data.warc.gz"}
        self.lines.append(f"{json.dumps(url or '')[1:-1].replace(' ', '%20')} {DATE[:19].replace('-', '').replace('T', '').replace(':', '')} {json.dumps(entry)}\n")
        self.data.write(part)
        self.size += len(part)

    def full(self) -> bool:
        return self.size >= PACKAGE_BYTES or len(self.lines) >= PACKAGE_RECORDS

    def close(self) -> pa.RecordBatch:
        """Write the index and the directory; the address and the number of records."""
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            f.writelines(x.encode() for x in sorted(self.lines))
        self.zip.close()
        self.out.close()
        return pa.RecordBatch.from_arrays([pa.array([self.path]), pa.array([len(self.lines)], pa.int64())], ["path", "records"])


class _Written:
    """A stream that can't seek, as zipfile wants it: it then writes sizes behind the data."""

    def __init__(self, out: BinaryIO):
        self.out = out

    def write(self, data: bytes) -> int:
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()


def _written(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = None
        for batch in slices(batches, 2):
            for page_id, url, html, refers_to in zip(*(c.cast(pa.binary()) if i == 2 else c for i, c in enumerate(batch.columns)), strict=True):
                package = package or Package(folder)
                payload = html.as_py() or b""
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                package.add(url.as_py(), digest, record(page_id.as_py(), url.as_py(), payload, digest, refers_to.as_py()))
                if package.full():
                    yield package.close()
                    package = None
        if package:
            yield package.close()

    return run


def write_packages(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """(path, records) of the packages written below `folder`, an address that all executors can write to, from pages (page_id, url, html).

    Of pages with equal payloads of at least `min_bytes` bytes, those with the smallest page_id are responses and the others
    revisits of it. Null html is an empty payload. Rows without a page_id are responses. An empty table writes nothing. Equal payloads meet by digest in a
    grouped minimum of ids, without their texts; the way back is a join that deals out payloads which very many pages have.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.sha1(F.col("html").cast("binary")), "large": F.octet_length("html") >= min_bytes})
    counted = cut(rows.select("page_id", "sha", "large"))
    first = counted.filter("large").groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first")
    rows = spread_join(rows, first, "sha", hot_keys(counted, "sha")[1], "left").select("page_id", "url", "html", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))
    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)
    return cut(rows.mapInArrow(_written(folder), "path string, records long"))


# ---- reading


class ZipError(ValueError):
    pass


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int


class ZipDirectory:
    """Members of a ZIP file from its central directory; `file` is anything that seeks and reads."""

    def __init__(self, file: BinaryIO):
        self.file = file
        self.size = file.seek(0, 2)
        count, size, start = self._end()
        self.members = {m.name: m for m in self._central(start, size, count)}

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise ZipError("the file ends early")
        return data

    def _end(self) -> tuple[int, int, int]:
        tail_at = max(0, self.size - 22 - FULL16)
        tail = self._read(tail_at, self.size - tail_at)
        at = tail.rfind(END)
        if at < 0 or len(tail) - at < 22:
            raise ZipError("no end of central directory")
        count, size, start = struct.unpack_from("<HII", tail, at + 10)
        end = tail_at + at
        if FULL16 in (count,) or FULL32 in (size, start):
            mark, _, where, _ = struct.unpack("<4sIQI", self._read(end - 20, 20))
            if mark != LOCATOR64:
                raise ZipError("no ZIP64 locator")
            data = self._read(where, 56)
            if data[:4] != END64:
                raise ZipError("no ZIP64 end of central directory")
            count, size, start = struct.unpack_from("<QQQ", data, 32)
        return count, size, start

    def _central(self, at: int, size: int, count: int) -> Iterator[Member]:
        """The entries one by one, so a directory of very many isn't held."""
        end = at + size
        for _ in range(count):
            fixed = self._read(at, 46)
            if fixed[:4] != CENTRAL or at + 46 > end:
                raise ZipError("a broken central directory")
            flags, method = struct.unpack_from("<HH", fixed, 8)
            packed, size = struct.unpack_from("<II", fixed, 20)
            n_name, n_extra, n_note = struct.unpack_from("<HHH", fixed, 28)
            header = struct.unpack_from("<I", fixed, 42)[0]
            rest = self._read(at + 46, n_name + n_extra)
            name, extra, k = rest[:n_name].decode("utf-8" if flags & 0x800 else "cp437"), rest[n_name:], 0
            while k + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, k)
                if kind == 1:  # ZIP64: only the fields that are full in the entry, in this order
                    wide = list(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                    size = wide.pop(0) if size == FULL32 else size
                    packed = wide.pop(0) if packed == FULL32 else packed
                    header = wide.pop(0) if header == FULL32 else header
                k += 4 + n
            yield Member(name, method, packed, header)
            at += 46 + n_name + n_extra + n_note

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        m = self.members[name]
        if m.method:
            raise ZipError(f"{name} is compressed; only stored members can be read by range")
        head = self._read(m.header, 30)
        if head[:4] != LOCAL:
            raise ZipError("no local header")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return m.header + 30 + n_name + n_extra

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        """A range of a stored member."""
        size = self.members[name].size
        length = size - offset if length is None else length
        if offset < 0 or length < 0 or offset + length > size:
            raise ZipError("a range outside the member")
        return self._read(self.start(name) + offset, length)

    def lines(self, name: str, size: int = 1 << 20) -> Iterator[bytes]:
        """The lines of a stored member, `size` bytes read at a time."""
        at, end, rest = self.start(name), self.members[name].size, b""
        for k in range(0, end, size):
            *whole, rest = (rest + self._read(at + k, min(size, end - k))).split(b"\n")
            yield from whole
        if rest:
            yield rest


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def package_records(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Every record that the indexes of a package list, each read by its range."""
    zipped = ZipDirectory(file)
    for index in (n for n in zipped.members if n.startswith("indexes/") and n.endswith((".cdxj", ".cdx"))):
        for line in zipped.lines(index):
            entry = json.loads(line.decode().split(" ", 2)[2])
            part = zipped.read(f"archive/{entry['filename']}", int(entry["offset"]), int(entry["length"]))
            yield parse_record(zlib.decompress(part, 31))


def _page(uri: str | None) -> int | None:
    return None if uri is None or uri == _uri(None) else int(uri.removeprefix("<urn:page:").removesuffix(">"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows: list[tuple] = []
            held = 0

            def out(rows: list[tuple]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

            store, at = fs.FileSystem.from_uri(path)
            with store.open_input_file(at) as file:
                for headers, block in package_records(file):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    kind = headers["warc-type"]
                    if kind == "response" and (size != len(payload) or digest != base64.b32encode(hashlib.sha1(payload).digest()).decode()):
                        raise ValueError(f"damaged payload of {headers['warc-record-id']}")
                    rows.append((_page(headers["warc-record-id"]), headers.get("warc-target-uri"), size, digest, kind, _page(headers.get("warc-refers-to")), payload if kind == "response" else None))
                    held += len(payload)
                    if held > 4 << 20 or len(rows) >= 10_000:
                        yield out(rows)
                        rows, held = [], 0
            if rows:
                yield out(rows)


def read_packages(packages: DataFrame) -> DataFrame:
    """Records of package files (path): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null in revisits)."""
    return packages.select("path").mapInArrow(_records, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def read_package_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of the package files below a path. Spark lists the files, a task for each or so; their contents are read by range only."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wacz").load(path).select("path")
    return read_packages(files.repartition(spark.sparkContext.defaultParallelism * 4))


def op7_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = write_packages(read_table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/packages-{uuid.uuid4().hex}")
    return read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS sha FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: (['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'])[strpos('0123456789abcdef', substr(sha, i, 1))]), '') AS bits FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM b)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM f
"""
