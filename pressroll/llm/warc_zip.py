"""WARC records in ZIP archives, read by byte ranges.

Layout of an archive (a file of the shared folder): stored members
``archive/data-N.warc.gz`` (one gzip member a record) and ``indexes/index.cdxj``
(one line a record: key, time and a JSON object with file name, offset and
length). Nothing is extracted and no member is read from its start:

1. a task reads an archive's end, its central directory (ZIP64 records and
   extra fields included) and the index, and returns blocks of neighbouring
   records as byte ranges of the archive; a WARC member that the index does not
   name is scanned once for its records' ends;
2. the blocks are dealt to tasks, which read their range and parse the records.

Writing: of equal payloads of at least ``min_bytes`` the one with the smallest
id is a ``response``, the others are ``revisit`` records without a payload, which
keep the HTTP header of the response. Payloads found in over a thousandth of
all rows (at most a thousand of them) are looked up in a broadcast table, so no
join key is hot; revisits leave their payload behind before the join. A task
closes an archive at ``archive_bytes``. The manifest holds the archives of the
tasks that were committed; what lost tasks left is not in it and is never read.

The archives are opened with ``pyarrow.fs``, so the shared folder may be on any
store it knows (local or mounted, hdfs, s3, gs).

Edge cases: a null payload is empty; rows that repeat the smallest id of a
payload are all responses; a null id is no id: its record refers to the
smallest one of its payload, or is the response where all are null; a null url
is left out; urls are kept to the byte (control characters and % escaped); an
empty table writes no archive; other columns are ignored. A payload is held in
memory whole, an archive or index never. A broken archive or record raises.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroll.llm.common import identified, materialize
from pressroll.session import configure, work_dir

#: Bytes after which a task closes an archive, and bytes of a block of records.
ARCHIVE_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
READ_BYTES = 1 << 20
WARC_DATE = "2024-01-01T00:00:00Z"
CDX_TIME = "20240101000000"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-record:"

MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = ("record_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, "
           "payload binary")

# Signatures of the ZIP format (fixed values).
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
WHOLE16, WHOLE32 = 0xFFFF, 0xFFFFFFFF
_SAFE = "".join(chr(c) for c in range(33, 127) if c != 37)


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


# ------------------------------------------------------------------- records

def _base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _record(record_id: str | None, url: str | None, refers_to: str | None, digest: str, n_bytes: int, payload: bytes | None) -> bytes:
    """A response (with payload) or revisit record of an HTTP answer."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}",
             f"WARC-Record-ID: <{_urn(record_id)}>", f"WARC-Date: {WARC_DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, _SAFE)}")
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_urn(refers_to)}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).digest())}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _urn(record_id: str | None) -> str:
    return f"{ID}none" if record_id is None else f"{ID}id:{quote(record_id, '')}"


def _from_urn(urn: str) -> str | None:
    name = urn.strip("<>").removeprefix(ID)
    return unquote(name[3:]) if name.startswith("id:") else None


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def parse_record(raw: bytes) -> dict | None:
    """The fields of ``RECORDS`` of one record; None for other record types.
    Lengths and digests that do not agree raise."""
    if not raw.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    end = raw.index(b"\r\n\r\n")
    fields = _fields(raw[:end])
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    size = int(fields["content-length"])
    block = raw[end + 4 : end + 4 + size]
    if len(block) != size or raw[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError("the record is cut off")
    stated = fields.get("warc-block-digest")
    if stated and stated != f"sha1:{_base32(hashlib.sha1(block).digest())}":
        raise ValueError("the block differs from its digest")
    http_end = block.index(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    payload = None
    n_bytes = int(_fields(block[:http_end])["content-length"])
    if kind == "response":
        payload = block[http_end + 4 :]
        if len(payload) != n_bytes or _base32(hashlib.sha1(payload).digest()) != digest:
            raise ValueError("the payload differs from its length or digest")
    url = fields.get("warc-target-uri")
    return {"record_id": _from_urn(fields["warc-record-id"]), "url": None if url is None else unquote(url), "record_type": kind,
            "refers_to": _from_urn(fields["warc-refers-to"]) if kind == "revisit" else None, "payload_bytes": n_bytes,
            "payload_digest": digest, "payload": payload}


# ------------------------------------------------------------------- writing

class _Archive:
    """An open archive: records go to the stored WARC member as they come, their
    index lines follow when it is closed."""

    def __init__(self, folder: str) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.zip"
        store, name = _store(self.path)
        store.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.out = store.open_output_stream(name)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member_name = "archive/data-0.warc.gz"
        self.member = self.zip.open(zipfile.ZipInfo(self.member_name), "w", force_zip64=True)
        self.offset, self.index = 0, []

    def add(self, url: str | None, digest: str, kind: str, record: bytes) -> None:
        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        raw = squeeze.compress(record) + squeeze.flush()
        self.member.write(raw)
        entry = {"url": url, "digest": f"sha1:{digest}", "mime": "warc/revisit" if kind == "revisit" else "text/html",
                 "filename": self.member_name.removeprefix("archive/"), "offset": self.offset, "length": len(raw)}
        self.index.append(f"{quote(url or '-', _SAFE)} {CDX_TIME} {json.dumps(entry, ensure_ascii=True)}\n")
        self.offset += len(raw)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo("indexes/index.cdxj"), "w", force_zip64=True) as out:
            for line in sorted(self.index):
                out.write(line.encode())
        self.zip.close()
        self.out.close()
        return self.path, len(self.index), self.offset


def _write_task(folder: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, closed = None, []
        for batch in batches:
            columns = [batch.column(k) for k in ("id", "url", "payload", "n_bytes", "sha1", "first", "revisit")]
            for row in range(batch.num_rows):
                record_id, url, payload, n_bytes, sha1, first, revisit = (c[row].as_py() for c in columns)
                digest = _base32(bytes.fromhex(sha1))
                archive = archive or _Archive(folder)
                archive.add(url, digest, "revisit" if revisit else "response",
                            _record(record_id, url, first, digest, n_bytes, None if revisit else payload or b""))
                if archive.offset >= archive_bytes:
                    closed.append(archive.close())
                    archive = None
        if archive:
            closed.append(archive.close())
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "n_records", "n_bytes"), c)) for c in closed],
                                         pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    return write


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0,
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row; returns the manifest (path, records and bytes of each archive)."""
    spark = configure(pages.sparkSession)
    rows = identified(pages, id_col, url_col, payload_col).toDF("id", "url", "payload")
    rows = rows.withColumn("payload", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    shared = rows.where(F.col("n_bytes") >= min_bytes).groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    copies = materialize(shared.where("n > 1"), "warc-copies")
    # Each of these is more than a thousandth of the rows of copies: a thousand of them at most.
    bound = copies.agg(F.sum("n")).first()[0] or 0
    hot = copies.where(F.col("n") * 1000 > bound).select(F.col("sha1").alias("_hot"), F.col("first").alias("_hot_first"))
    cool = copies.where(F.col("n") * 1000 <= bound).select(F.col("sha1").alias("_cool"), F.col("first").alias("_cool_first"))
    known = rows.join(F.broadcast(hot), F.col("sha1") == F.col("_hot"), "left")
    is_hot = F.col("_hot").isNotNull()
    known = known.withColumn("payload", F.when(is_hot & ~F.col("id").eqNullSafe(F.col("_hot_first")), F.lit(None)).otherwise(F.col("payload")))
    # Rows already known join with nothing, each under a key of its own.
    key = F.when(is_hot, F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string"))).otherwise(F.col("sha1"))
    joined = known.withColumn("_key", key).join(cool, F.col("_key") == F.col("_cool"), "left")
    found = is_hot | F.col("_cool").isNotNull()
    first = F.when(is_hot, F.col("_hot_first")).otherwise(F.col("_cool_first"))
    revisit = found & ~F.col("id").eqNullSafe(first)
    ready = joined.select(F.col("id").cast("string").alias("id"), "url", F.when(~revisit, F.col("payload")).alias("payload"), "n_bytes", "sha1",
                          first.cast("string").alias("first"), revisit.alias("revisit"))
    return materialize(ready.mapInArrow(_write_task(work_dir(spark, "warc"), archive_bytes), MANIFEST), "warc-manifest")


# ------------------------------------------------------------------- reading

@dataclass
class Member:
    name: str
    start: int
    size: int
    stored: bool


def members(file: pa.NativeFile) -> list[Member]:
    """Members of a ZIP archive and where their bytes start, from the central
    directory and the local headers only."""
    size = file.size()
    tail_at = max(0, size - (22 + WHOLE16))
    tail = file.read_at(size - tail_at, tail_at)
    at = len(tail) - 22
    while at >= 0 and not (tail[at : at + 4] == struct.pack("<I", END) and struct.unpack_from("<H", tail, at + 20)[0] == len(tail) - at - 22):
        at = tail.rfind(struct.pack("<I", END), 0, at + 3) if at > 0 else -1
    if at < 0:
        raise ValueError("no end of a central directory: not a ZIP archive")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if WHOLE16 == count or WHOLE32 in (length, start):
        locator_at = tail_at + at - 20
        locator = file.read_at(20, locator_at) if locator_at >= 0 else b""
        if locator[:4] == struct.pack("<I", LOCATOR64):
            end64 = file.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
            if end64[:4] != struct.pack("<I", END64):
                raise ValueError("the ZIP64 end record is not where its locator says")
            count, length, start = struct.unpack_from("<QQQ", end64, 32)
    directory = file.read_at(length, start)
    found, at = [], 0
    for _ in range(count):
        if directory[at : at + 4] != struct.pack("<I", CENTRAL):
            raise ValueError("the central directory is cut off")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        offset = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        # ZIP64 extra field: the values that do not fit, in this order.
        place = 0
        while place + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, place)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, place + 4))
                plain = next(wide) if plain == WHOLE32 else plain
                packed = next(wide) if packed == WHOLE32 else packed
                offset = next(wide) if offset == WHOLE32 else offset
            place += 4 + n
        head = file.read_at(30, offset)
        if head[:4] != struct.pack("<I", LOCAL):
            raise ValueError(f"member {name} has no local header")
        found.append(Member(name, offset + 30 + sum(struct.unpack_from("<HH", head, 26)), packed, method == 0))
        at += 46 + n_name + n_extra + n_comment
    return found


def _pieces(file: pa.NativeFile, member: Member) -> Iterator[bytes]:
    for at in range(0, member.size, READ_BYTES):
        yield file.read_at(min(READ_BYTES, member.size - at), member.start + at)


def _index_entries(file: pa.NativeFile, member: Member) -> Iterator[tuple[str, int, int]]:
    """(file name, offset, length) of the lines of a .cdx, .cdxj or gzipped index."""
    unzip = zlib.decompressobj(47) if member.name.endswith(".gz") else None
    rest = b""
    for piece in _pieces(file, member):
        while piece:
            plain = piece if unzip is None else unzip.decompress(piece)
            piece = b"" if unzip is None or not unzip.eof else unzip.unused_data
            if unzip is not None and unzip.eof:
                unzip = zlib.decompressobj(47)
            *lines, rest = (rest + plain).split(b"\n")
            yield from filter(None, map(_index_line, lines))
    last = _index_line(rest)
    if last:
        yield last


def _index_line(line: bytes) -> tuple[str, int, int] | None:
    brace = line.find(b"{")
    if brace < 0:
        return None
    entry = json.loads(line[brace:])
    return entry["filename"], int(entry["offset"]), int(entry["length"])


def _scanned(file: pa.NativeFile, member: Member) -> Iterator[tuple[int, int]]:
    """Offset and length of the records of a member without index lines."""
    if member.name.endswith(".gz"):
        start, unzip, at = 0, zlib.decompressobj(31), 0
        for piece in _pieces(file, member):
            while piece:
                unzip.decompress(piece)
                at += len(piece)
                piece = b""
                if unzip.eof:
                    piece = unzip.unused_data
                    at -= len(piece)
                    yield start, at - start
                    start, unzip = at, zlib.decompressobj(31)
        if start != at:
            raise ValueError(f"member {member.name} is cut off")
        return
    at = 0
    while at < member.size:
        head, size = b"", 4096
        while b"\r\n\r\n" not in head:
            if len(head) == member.size - at:
                raise ValueError(f"member {member.name} is cut off")
            head = file.read_at(min(size, member.size - at), member.start + at)
            size *= 4
        end = head.index(b"\r\n\r\n")
        length = end + 4 + int(_fields(head[:end])["content-length"]) + 4
        yield at, length
        at += length


def _blocks(path: str, block_bytes: int) -> Iterator[dict]:
    """Ranges of neighbouring records of the archive, with their lengths."""
    store, name = _store(path)
    with store.open_input_file(name) as file:
        found = members(file)
        named: dict[str, list[tuple[int, int]]] = {}
        for member in found:
            if re.search(r"(^|/)indexes/[^/]+\.cdxj?(\.gz)?$", member.name):
                if not member.stored:
                    raise ValueError(f"index {member.name} of {path} is not stored")
                for filename, offset, length in _index_entries(file, member):
                    named.setdefault(filename, []).append((offset, length))
        for member in found:
            if not re.search(r"\.warc(\.gz)?$", member.name):
                continue
            if not member.stored:
                raise ValueError(f"member {member.name} of {path} is not stored")
            listed = named.get(member.name.rsplit("/", 1)[-1]) or named.get(member.name)
            places = np.array(sorted(set(listed)) if listed else list(_scanned(file, member)), np.int64).reshape(-1, 2)
            first = 0
            while first < len(places):
                last = first + 1
                while last < len(places) and places[last, 0] == places[last - 1].sum() and places[last].sum() - places[first, 0] <= block_bytes:
                    last += 1
                yield {"path": path, "gzip": member.name.endswith(".gz"), "start": int(member.start + places[first, 0]),
                       "lengths": places[first:last, 1].tolist()}
                first = last


BLOCKS = "path string, gzip boolean, start long, lengths array<long>"
_BLOCKS = pa.schema([("path", pa.string()), ("gzip", pa.bool_()), ("start", pa.int64()), ("lengths", pa.list_(pa.int64()))])
_RECORDS = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
                      ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _locate_task(block_bytes: int):
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield pa.RecordBatch.from_pylist(list(_blocks(path, block_bytes)), _BLOCKS)

    return locate


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.to_pylist():
            store, name = _store(block["path"])
            with store.open_input_file(name) as file:
                raw = file.read_at(sum(block["lengths"]), block["start"])
            at, records = 0, []
            for length in block["lengths"]:
                one = raw[at : at + length]
                records.append(parse_record(zlib.decompress(one, 31) if block["gzip"] else one))
                at += length
            yield pa.RecordBatch.from_pylist([r for r in records if r], _RECORDS)


def locate(manifest: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Byte ranges of the records of the archives named in ``path``."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(n).mapInArrow(_locate_task(block_bytes), BLOCKS)


def read_archives(manifest: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The response and revisit records of the archives (columns of ``RECORDS``)."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return locate(manifest, block_bytes).repartition(n).mapInArrow(_read_task, RECORDS)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", **options) -> DataFrame:
    """A row per page, read back from the archives written of them: id, url,
    ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``."""
    kind = identified(pages, id_col).schema[id_col].dataType
    records = read_archives(write_archives(pages, id_col, url_col, payload_col, **options))
    return records.select(F.col("record_id").cast(kind).alias(id_col), F.col("url").alias(url_col), "payload_bytes", "payload_digest", "record_type",
                          F.col("refers_to").cast(kind).alias("refers_to"))
