"""WARC records in ZIP packages: written by tasks, read by byte ranges without extraction.

A package is a ZIP file with stored (uncompressed) members: `archive/data.warc.gz`, one gzip member per record, and
`indexes/index.cdxj`, a line per record with its place. The reader takes the end of the file, the ZIP64 or plain end
record, the central directory, the local headers and the index, and then ranges of records. A package without an
index is scanned record by record in ranges of bounded size.

Writing gives a manifest of the files that finished; files of failed task attempts are not in it. A null text is an
empty payload. A null id or URL is left out of the record and read back as null. Repeated rows give repeated records.
Packages that break the format raise an error that names the file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.llm.files import attempt_name, locate, read_range, write_file
from threatloom.llm.scratch import store
from threatloom.session import run_dir

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
MIN_REVISIT_BYTES = 1000
#: A package is closed at this size; a range read takes at most this much, or one record.
PACKAGE_BYTES = 32 << 20
RANGE_BYTES = 4 << 20
WARC_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "package string, bytes long, records long"
ENTRY = "package string, offset long, length long"
RECORD = (
    "record_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, "
    "payload binary"
)


# -- writing -----------------------------------------------------------------------------------------------------

def _header_text(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def warc_record(record_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record; with `refers_to` a revisit, which has the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {WARC_DATE}"]
    if record_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{_header_text(record_id)}>")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_text(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{_header_text(refers_to)}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def zip_package(members: dict[str, list[bytes]]) -> list[bytes]:
    """Parts of a ZIP file with stored members, always with ZIP64 fields."""
    out: list[bytes] = []
    directory: list[bytes] = []
    at = 0
    for name, parts in members.items():
        size, crc = sum(map(len, parts)), 0
        for part in parts:
            crc = zlib.crc32(part, crc)
        raw = name.encode()
        local = struct.pack("<4s5H3I2H", b"PK\x03\x04", 45, 0x800, 0, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 20)
        local += raw + struct.pack("<2H2Q", 1, 16, size, size)
        directory.append(
            struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0x800, 0, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 28,
                        0, 0, 0, 0, 0xFFFFFFFF)
            + raw + struct.pack("<2H3Q", 1, 24, size, size, at)
        )
        out += [local, *parts]
        at += len(local) + size
    central = b"".join(directory)
    end = struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, len(directory), len(directory), len(central), at)
    end += struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(central), 1)
    end += struct.pack("<4s4H2IH", b"PK\x05\x06", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    return [*out, central, end]


class _Package:
    def __init__(self, folder: str):
        self.folder, self.count = folder, 0
        self._clear()

    def _clear(self) -> None:
        self.records: list[bytes] = []
        self.lines: list[bytes] = []
        self.size = 0

    def add(self, url: str | None, member: bytes) -> None:
        entry = {"offset": self.size, "length": len(member)}
        self.lines.append(f"{_header_text(url or '-')} {WARC_DATE} {json.dumps(entry)}\n".encode())
        self.records.append(member)
        self.size += len(member)

    def close(self) -> dict | None:
        if not self.records:
            return None
        uri = f"{self.folder}/{attempt_name()}-{self.count:05d}.zip"
        parts = zip_package({ARCHIVE: self.records, INDEX: self.lines})
        write_file(uri, parts)
        row = {"package": uri, "bytes": sum(map(len, parts)), "records": len(self.records)}
        self.count += 1
        self._clear()
        return row


def _writer(folder: str, package_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = _Package(folder)
        rows = []
        for batch in batches:
            for row in batch.to_pylist():
                payload = (row["text"] or "").encode()
                record = warc_record(row["id"], row["url"], payload, row["digest"], row["refers_to"])
                package.add(row["url"], gzip_member(record))
                if package.size >= package_bytes:
                    rows.append(package.close())
        rows.append(package.close())
        yield pa.RecordBatch.from_pylist([r for r in rows if r], pa.schema(
            [("package", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return write


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Pages with `digest` and, where an equal payload of at least `min_bytes` has a larger id, its id in `refers_to`.

    Only ids and digests are shuffled to find the groups; a group of any size is one aggregate.
    """
    payload = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    sized = pages.select("id", "url", "text").withColumns({"digest": F.sha1(payload), "_bytes": F.octet_length(payload)})
    keys = sized.where(F.col("_bytes") >= min_bytes).select("id", "digest", "_bytes")
    last = keys.groupBy("digest", "_bytes").agg(F.max("id").alias("refers_to"), F.count("*").alias("_n")).where("_n > 1")
    revisits = keys.join(last, ["digest", "_bytes"]).where("id <> refers_to").select("id", "digest", "refers_to")
    return sized.join(revisits.distinct(), ["id", "digest"], "left").select("id", "url", "text", "digest", "refers_to")


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write pages (`id` of any type, `url`, `text`) as packages below a folder all executors reach; the manifest."""
    rows = with_revisits(pages).select(
        F.col("id").cast("string").alias("id"), F.col("url").cast("string").alias("url"), "text", "digest",
        F.col("refers_to").cast("string").alias("refers_to"),
    )
    return store(rows.mapInArrow(_writer(folder, package_bytes), MANIFEST), "warc-manifest")


# -- reading -----------------------------------------------------------------------------------------------------

class Member(NamedTuple):
    name: str
    offset: int
    size: int


def central_directory(uri: str) -> tuple[bytes, int]:
    """The central directory of a ZIP file, plain or ZIP64, and the file's size."""
    system, path = locate(uri)
    size = system.get_file_info(path).size
    if size is None or size < 22:
        raise ValueError(f"{uri}: not a ZIP package")
    tail_at = max(0, size - 22 - 0xFFFF - 20)
    tail = read_range(uri, tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06", 0, len(tail) - 18)  # the record has 22 bytes
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)  # the mark may also stand in the comment
    if at < 0:
        raise ValueError(f"{uri}: no end of central directory")
    length, offset = struct.unpack_from("<2I", tail, at + 12)
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        (end64,) = struct.unpack_from("<Q", tail, at - 12)
        record = read_range(uri, end64, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError(f"{uri}: no ZIP64 end record")
        length, offset = struct.unpack_from("<2Q", record, 40)
    return read_range(uri, offset, length), size


def stored_members(uri: str) -> dict[str, Member]:
    """Stored members by name, with the place of their data. Archives and indexes must be stored, since they are read by ranges;
    other members may be compressed and are left out."""
    directory, _ = central_directory(uri)
    found, at = {}, 0
    while at + 46 <= len(directory):
        mark, method, size, real, names, extras, notes, offset = (
            directory[at : at + 4], *struct.unpack_from("<H", directory, at + 10),
            *struct.unpack_from("<2I", directory, at + 20), *struct.unpack_from("<3H", directory, at + 28),
            *struct.unpack_from("<I", directory, at + 42),
        )
        if mark != b"PK\x01\x02":
            raise ValueError(f"{uri}: broken central directory")
        name = directory[at + 46 : at + 46 + names].decode()
        extra = directory[at + 46 + names : at + 46 + names + extras]
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<2H", extra)
            if kind == 1:  # only the fields that are full in the plain record, in this order
                values = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                real = next(values) if real == 0xFFFFFFFF else real
                size = next(values) if size == 0xFFFFFFFF else size
                offset = next(values) if offset == 0xFFFFFFFF else offset
            extra = extra[4 + length :]
        if method == 0:
            local = read_range(uri, offset, 30)
            if local[:4] != b"PK\x03\x04":
                raise ValueError(f"{uri}: no local header of {name}")
            found[name] = Member(name, offset + 30 + sum(struct.unpack_from("<2H", local, 26)), size)
        elif name.startswith("archive/") or name == INDEX:
            raise ValueError(f"{uri}: {name} is compressed and cannot be read by ranges")
        at += 46 + names + extras + notes
    return found


def _scanned(uri: str, member: Member) -> Iterator[tuple[int, int]]:
    """Places of the gzip members of an archive without index."""
    at, done, begin, packer = 0, member.size, 0, zlib.decompressobj(31)
    while at < done:
        data = read_range(uri, member.offset + at, min(RANGE_BYTES, done - at))
        at += len(data)
        while data:
            packer.decompress(data)
            if not packer.eof:
                break
            data = packer.unused_data
            yield begin, at - len(data) - begin
            begin, packer = at - len(data), zlib.decompressobj(31)
    if begin < done:
        raise ValueError(f"{uri}: the last record of {member.name} is cut off")


def _scanned_plain(uri: str, member: Member) -> Iterator[tuple[int, int]]:
    """Places of the records of an uncompressed archive, by their lengths."""
    at, held, data = 0, 0, b""  # `data` begins at `held`
    while at < member.size:
        end = data.find(b"\r\n\r\n", at - held) if at < held + len(data) else -1
        if end < 0:
            size, data = max(RANGE_BYTES, 2 * (len(data) if held == at else 0)), b""
            held, data = at, read_range(uri, member.offset + at, min(size, member.size - at))
            end = data.find(b"\r\n\r\n")
            if end < 0 and len(data) < member.size - at:
                continue
        head = data[at - held : max(end, 0)].split(b"\r\n")
        sizes = [int(x.split(b":", 1)[1]) for x in head if x.lower().startswith(b"content-length:")]
        if not head[0].startswith(b"WARC/1.") or len(sizes) != 1:
            raise ValueError(f"{uri}: no record at {at} of {member.name}")
        length = end - (at - held) + 4 + sizes[0] + 4
        if at + length > member.size:
            raise ValueError(f"{uri}: the last record of {member.name} is cut off")
        yield at, length
        at += length


def package_entries(uri: str) -> Iterator[tuple[int, int]]:
    """Absolute place and length of every record of a package."""
    members = stored_members(uri)
    archives = [m for n, m in members.items() if n.startswith("archive/") and n.endswith((".warc.gz", ".warc"))]
    index = members.get(INDEX)
    if index and [m.name for m in archives] == [ARCHIVE]:
        base = archives[0].offset
        for line in read_range(uri, index.offset, index.size).splitlines():
            entry = json.loads(line[line.index(b"{") :])
            yield base + entry["offset"], entry["length"]
        return
    for member in archives:
        for offset, length in (_scanned if member.name.endswith(".gz") else _scanned_plain)(uri, member):
            yield member.offset + offset, length


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column("package").to_pylist():
            places = list(package_entries(uri))
            yield pa.RecordBatch.from_arrays(
                [pa.array([uri] * len(places), pa.string()), pa.array([p[0] for p in places], pa.int64()),
                 pa.array([p[1] for p in places], pa.int64())], names=["package", "offset", "length"])


def record_index(manifest: DataFrame) -> DataFrame:
    """Place of every record of the manifest's packages."""
    return manifest.select("package").mapInArrow(_entries, ENTRY)


def _urn(value: str | None) -> str | None:
    return value.removeprefix("<").removesuffix(">").removeprefix("urn:page:") if value is not None else None


def parse_record(data: bytes) -> dict:
    """Fields of one decompressed record; digest and length of a response are those of what was read."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response":
        length, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if digest != stated:
            raise ValueError(f"payload of {fields.get('WARC-Record-ID')} has another digest")
    else:
        headers = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
        length, digest, payload = int(headers["Content-Length"]), stated, None
    return {
        "record_id": _urn(fields.get("WARC-Record-ID")), "url": fields.get("WARC-Target-URI"), "record_type": kind,
        "refers_to": _urn(fields.get("WARC-Refers-To")), "payload_bytes": length, "payload_digest": digest,
        "payload": payload,
    }


_RECORD_TYPE = pa.schema([
    ("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
])


def _reader(with_payload: bool):
    def taken(uri: str, places: list[tuple[int, int]]) -> pa.RecordBatch:
        first = places[0][0]
        data = read_range(uri, first, places[-1][0] + places[-1][1] - first)
        rows = []
        for offset, length in places:
            record = data[offset - first : offset - first + length]
            row = parse_record(zlib.decompress(record, 31) if record[:2] == b"\x1f\x8b" else record)
            rows.append(row if with_payload else row | {"payload": None})
        return pa.RecordBatch.from_pylist(rows, _RECORD_TYPE)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, places = None, []
        for batch in batches:
            for uri, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                # ranges that follow each other are read at once
                if places and (uri != package or offset != sum(places[-1]) or offset + length - places[0][0] > RANGE_BYTES):
                    yield taken(package, places)
                    places = []
                package = uri
                places.append((offset, length))
        if places:
            yield taken(package, places)

    return read


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records at the places of an index, which may be filtered before; neighbours are read together."""
    dealt = index.select(*(f.split()[0] for f in ENTRY.split(", "))).repartition(
        F.col("package"), F.floor(F.col("offset") / RANGE_BYTES)
    ).sortWithinPartitions("package", "offset")
    return dealt.mapInArrow(_reader(with_payload), RECORD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.col("page_id").alias("id"), "url", F.col("html").alias("text")
    )
    manifest = write_packages(pages, run_dir(spark, "llm-warc"))
    return read_records(record_index(manifest), with_payload=False).select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS bytes FROM pages),
     m AS (SELECT *, max(page_id) OVER (PARTITION BY digest, bytes) AS last FROM p)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
       CASE WHEN bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= 1000 AND last <> page_id THEN last END AS refers_to
FROM m
"""
