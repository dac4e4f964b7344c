"""WARC records in ZIP packages, read by range without extraction.

A package is a ZIP whose members are stored uncompressed: ``archive/data.warc.gz``
(one gzip member a record) and ``indexes/index.cdxj`` (one JSON line a record, with
offset and length inside the archive).  The reader parses the central directory,
ZIP64 included, finds both members, reads the index, and then fetches records by
byte range.  Payloads that occur several times are stored once; later records are
revisits that refer to the first.

Packages are listed in a manifest that Spark commits.  A file left behind by a lost
or repeated task is not in the manifest and is never read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import new_table_path, written

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2000-01-01T00:00:00Z"


@dataclass(frozen=True)
class PackageParameters:
    """Records and bytes after which a new package begins; least size of a revisited payload."""

    records: int = 8192
    size: int = 64 << 20
    level: int = 4
    least_revisit: int = 100
    read_span: int = 4 << 20


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a plain path is local."""
    local = re.sub(r"^file:/+", "/", uri)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(uri)


# --- records ---------------------------------------------------------------


def records_of(pages: DataFrame, how: PackageParameters = PackageParameters()) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to, revisit.

    Only payloads that occur more than once are joined back, so that a corpus
    with few repeated payloads is not shuffled.  A NULL html is an empty payload.
    Rows that share the smallest page_id of a payload are all responses, as are
    all rows of a payload without any page_id.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumns(
        {"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha2("payload", 256)}
    )
    repeated = written(
        rows.where(F.col("payload_bytes") >= how.least_revisit)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 and first_id is not null")
        .select("payload_digest", "first_id"),
        "repeated-payloads",
    )
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return (
        rows.join(repeated, "payload_digest", "left")
        .withColumn("revisit", revisit)
        .withColumn("refers_to", F.when(F.col("revisit"), F.col("first_id")))
        .drop("first_id")
    )


def _header(fields: dict[str, object]) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields.items() if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode()


def warc_record(row: dict) -> bytes:
    """One record; a revisit carries the digest and size of its payload, not the payload."""
    revisit, payload = row["revisit"], row["payload"]
    url = row["url"]
    if url is not None:  # a header value is one line
        url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = head if revisit else head + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{row['page_id']}>" if row["page_id"] is not None else "<urn:page>",
        "WARC-Date": DATE,
        "WARC-Target-URI": url,
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "WARC-Refers-To": f"<urn:page:{row['refers_to']}>" if revisit else None,
        "WARC-Payload-Digest": f"sha256:{row['payload_digest']}",
        "X-Payload-Length": row["payload_bytes"],
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    return _header(fields) + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of a record, with its payload; a wrong digest or length is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(fields["X-Payload-Length"])
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")

    def page(value: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
        return int(found[1]) if found else None

    return {
        "page_id": page(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": page(fields.get("WARC-Refers-To")),
        "payload": payload if kind == "response" else None,
    }


# --- packages --------------------------------------------------------------


class PackageWriter:
    """Streams records into one ZIP; sizes and checksums follow the data."""

    def __init__(self, uri: str, level: int):
        self.uri, self.level = uri, level
        store, path = open_store(uri)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.sink = store.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)
        self.archive = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.index: list[str] = []
        self.size = 0

    def add(self, row: dict) -> None:
        gz = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = gz.compress(warc_record(row)) + gz.flush()
        self.archive.write(member)
        entry = {"page_id": row["page_id"], "offset": self.size, "length": len(member)}
        self.index.append(json.dumps(entry))
        self.size += len(member)

    def close(self) -> int:
        """Write index and directory; returns the number of records."""
        self.archive.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        self.zip.close()
        self.sink.close()
        return len(self.index)


def write_packages(records: DataFrame, folder: str, how: PackageParameters = PackageParameters()) -> DataFrame:
    """Write ``records`` as packages below ``folder``; returns the manifest (package, records)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: PackageWriter | None = None
        done: list[tuple[str, int]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                out = out or PackageWriter(f"{folder}/{uuid.uuid4().hex}.zip", how.level)
                out.add({name: batch.column(name)[i].as_py() for name in batch.schema.names})
                if len(out.index) >= how.records or out.size >= how.size:
                    done.append((out.uri, out.close()))
                    out = None
        if out:
            done.append((out.uri, out.close()))
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())],
                names=["package", "records"],
            )

    return written(records.mapInArrow(run, "package string, records bigint"), "manifest")


@dataclass(frozen=True)
class Member:
    """A stored member: where its bytes start and how many there are."""

    name: str
    start: int
    size: int


def zip_members(source) -> dict[str, Member]:
    """Stored members of a ZIP, from its central directory.

    ``source`` has size() and read_at(length, offset).  The end record is looked
    for in the last 65,557 bytes; where a count, size or offset there is saturated,
    the ZIP64 end record and the ZIP64 extra fields give the real one.
    """
    total = source.size()
    tail_at = max(0, total - 65_557)
    tail = source.read_at(total - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(b"PK\x05\x06", 0, end)  # the mark may occur inside a comment
    if end < 0:
        raise ValueError("no end of central directory")
    count, size, at = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or size == 0xFFFFFFFF or at == 0xFFFFFFFF:
        locator = source.read_at(20, tail_at + end - 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record = source.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, size, at = struct.unpack_from("<QQQ", record, 32)
    directory = source.read_at(size, at)
    members, place = {}, 0
    for _ in range(count):
        if directory[place : place + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", directory, place + 10)[0]
        packed, plain = struct.unpack_from("<II", directory, place + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", directory, place + 28)
        header = struct.unpack_from("<I", directory, place + 42)[0]
        name = directory[place + 46 : place + 46 + n_name].decode()
        extra = directory[place + 46 + n_name : place + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<HH", extra)
            if kind == 1:  # only the saturated fields, in this order
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            extra = extra[4 + length :]
        if method == 0:
            local = source.read_at(30, header)
            if local[:4] != b"PK\x03\x04":
                raise ValueError(f"no local header of {name}")
            skip = sum(struct.unpack_from("<HH", local, 26))
            members[name] = Member(name, header + 30 + skip, packed)
        place += 46 + n_name + n_extra + n_comment
    return members


class _Source:
    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.file = store.open_input_file(path)

    def size(self) -> int:
        return self.file.size()

    def read_at(self, length: int, offset: int) -> bytes:
        return self.file.read_at(length, offset)


def read_package(source, span: int) -> Iterator[dict]:
    """Records of a package; neighbouring records are fetched in one range of about ``span`` bytes."""
    members = zip_members(source)
    archive, index = members[ARCHIVE], members[INDEX]
    lines = source.read_at(index.size, index.start).decode().split("\n")
    entries = [json.loads(line) for line in lines if line]
    i = 0
    while i < len(entries):
        first, j = entries[i]["offset"], i + 1
        until = first + entries[i]["length"]
        while j < len(entries) and entries[j]["offset"] == until and until - first < span:
            until += entries[j]["length"]
            j += 1
        block = source.read_at(until - first, archive.start + first)
        for e in entries[i:j]:
            at = e["offset"] - first
            yield parse_record(zlib.decompress(block[at : at + e["length"]], 31))
        i = j


READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_packages(
    manifest: DataFrame, payloads: bool = True, how: PackageParameters = PackageParameters()
) -> DataFrame:
    """All records of the packages in ``manifest``; with ``payloads`` also their payload."""
    fields = [f.split()[0] for f in READ.split(", ")] + ["payload"] * payloads
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("package").to_pylist():
                held: list[dict] = []
                weight = 0
                for record in read_package(_Source(uri), how.read_span):
                    held.append(record)
                    weight += len(record["payload"] or b"") * payloads + 100
                    if weight > how.read_span:
                        yield out(held)
                        held, weight = [], 0
                if held:
                    yield out(held)

    def out(rows: list[dict]) -> pa.RecordBatch:
        columns = [pa.array([r[f] for r in rows], kinds.get(f, pa.string())) for f in fields]
        return pa.RecordBatch.from_arrays(columns, names=fields)

    # One package a task: a package is bounded by its parameters.
    tasks = max(1, manifest.count())
    spread = manifest.select("package").repartition(tasks)
    return spread.mapInArrow(run, READ + ", payload binary" * payloads)


def through_packages(spark: SparkSession, pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write all pages as packages in the shared folder and read them back."""
    folder = new_table_path(spark, "packages")
    manifest = write_packages(records_of(pages), folder)
    return read_packages(manifest, payloads)
