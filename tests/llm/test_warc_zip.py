"""WARC records in ZIP archives: round trip, directories, indexes, faults."""

import base64
import gzip
import hashlib
import json
import zipfile

import pyarrow.fs as pafs
import pytest
from pyspark.sql import types as T

from pressroll.llm import warc_zip

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                      *[T.StructField(c, T.StringType()) for c in ("id", "payload", "sha1", "first", "n", "path", "_key", "_hot")]])
URLS = ["http://a.example/", "http://a.example/x y?q=1%20é\n#f", None, ""]
BODIES = ["<p>same</p>", None, "", "long " * 60_000, "ü\U0001f600\r\n\r\n", "<p>same</p>"]


def _pages(spark):
    rows = [(i, URLS[i % 4], BODIES[i % 6]) for i in range(40)]
    rows += [(None, URLS[0], "<p>same</p>"), (None, None, "only here"), (3, URLS[3], BODIES[3]), (2, URLS[1], BODIES[5]), (100, URLS[1], "single")]
    return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], PAGES)


def _expected(rows, least=0):
    first = {}
    for i, _, body in rows:
        raw = (body or "").encode()
        if i is not None and len(raw) >= least:
            first[raw] = min(i, first.get(raw, i))
    out = []
    for i, url, body in rows:
        raw = (body or "").encode()
        response = first.get(raw) == i
        out.append((i, url, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit",
                    None if response else first[raw]) if raw in first or i is None and len(raw) >= least and first.get(raw) is not None
                   else (i, url, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response", None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 12])
def test_archive_round_trip(spark, least):
    pages = _pages(spark)
    plain = [tuple(r)[:3] for r in pages.collect()]
    found = warc_zip.archived(pages, min_bytes=least, archive_bytes=2000).collect()
    assert sorted([tuple(r) for r in found], key=str) == _expected(plain, least)


def test_payloads_come_back_whole(spark):
    manifest = warc_zip.write_archives(_pages(spark), archive_bytes=500)
    assert manifest.count() > 1
    got = {r["payload_digest"]: bytes(r["payload"]) for r in warc_zip.read_archives(manifest, block_bytes=300).where("payload IS NOT NULL").collect()}
    assert set(got.values()) == {(b or "").encode() for b in [*BODIES, "only here", "single"]}
    assert warc_zip.read_archives(manifest).where("record_type = 'revisit' AND payload IS NOT NULL").count() == 0


def test_hot_payload_takes_the_broadcast_way(spark):
    """A payload of a third of the rows, besides many pairs under the thousandth."""
    rows = [(i, "http://h.example/", "hot" if i % 3 == 0 else f"p{i // 2}") for i in range(6000)]
    found = warc_zip.archived(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted([tuple(r) for r in found.collect()], key=str) == _expected(rows)


def test_archives_are_zip_files_with_index(spark):
    manifest = warc_zip.write_archives(_pages(spark).coalesce(1)).collect()
    with zipfile.ZipFile(manifest[0]["path"].removeprefix("file:")) as z:
        assert z.testzip() is None
        assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
        warc = z.read("archive/data-0.warc.gz")
        lines = z.read("indexes/index.cdxj").decode().splitlines()
    assert len(lines) == manifest[0]["n_records"] == 45 and lines == sorted(lines)
    for line in lines:
        at = json.loads(line[line.index("{"):])
        assert gzip.decompress(warc[at["offset"] : at["offset"] + at["length"]]).startswith(b"WARC/1.1\r\n")


def test_nothing_to_archive(spark):
    none = warc_zip.archived(_pages(spark).where("false"))
    assert none.columns == ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] and none.count() == 0


# --------------------------------------------------- archives of other writers

RECORDS = [warc_zip._record(str(i), f"http://x.example/{i}", None, base64.b32encode(hashlib.sha1(b"b" * i).digest()).decode(), i, b"b" * i)
           for i in range(30)]
INFO = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"


def _write(path, members, comment=b"", method=zipfile.ZIP_STORED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, data in members:
            z.writestr(name, data)
        z.comment = comment


def _packed(records, zipped):
    raw, index, at = b"", [], 0
    for r in records:
        one = gzip.compress(r) if zipped else r
        index.append((at, len(one)))
        raw, at = raw + one, at + len(one)
    return raw, index


def _read(spark, path):
    manifest = spark.createDataFrame([(str(path),)], "path string")
    return sorted(int(r["record_id"]) for r in warc_zip.read_archives(manifest, block_bytes=2000).collect())


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("index", ["cdxj", "cdx.gz", None])
def test_foreign_archives(spark, tmp_path, zipped, index):
    name = "data.warc.gz" if zipped else "data.warc"
    raw, places = _packed([INFO, *RECORDS], zipped)
    lines = "".join(f"com,x)/ 2024 {json.dumps({'filename': name, 'offset': a, 'length': str(n)})}\n" for a, n in reversed(places)).encode()
    files = [("pages/pages.jsonl", b"{}"), (f"archive/{name}", raw)]
    if index == "cdxj":
        files.append(("indexes/index.cdxj", b"!meta line\n" + lines))
    elif index:
        files.append(("indexes/index.cdx.gz", gzip.compress(lines[:700]) + gzip.compress(lines[700:])))
    _write(tmp_path / "a.zip", files, comment=b"PK\x05\x06 a comment that looks like an end")
    assert _read(spark, tmp_path / "a.zip") == list(range(30))


def test_zip64_directories(spark, tmp_path, monkeypatch):
    """With the limit of the 32-bit fields lowered, the writer puts sizes, offsets
    and the end of the directory into the ZIP64 forms."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 200)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    raw, _ = _packed(RECORDS, True)
    _write(tmp_path / "a.zip", [("first.txt", b"x" * 500), ("archive/data.warc.gz", raw)])
    content = (tmp_path / "a.zip").read_bytes()
    assert b"PK\x06\x06" in content and b"PK\x06\x07" in content
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "a.zip")) as f:
        found = {m.name: m for m in warc_zip.members(f)}
        assert f.read_at(found["first.txt"].size, found["first.txt"].start) == b"x" * 500
    assert _read(spark, tmp_path / "a.zip") == list(range(30))


def test_broken_archives_raise(tmp_path):
    raw, _ = _packed(RECORDS, True)
    _write(tmp_path / "packed.zip", [("archive/data.warc.gz", raw)], method=zipfile.ZIP_DEFLATED)
    with pytest.raises(ValueError, match="not stored"):
        list(warc_zip._blocks(str(tmp_path / "packed.zip"), 1000))
    _write(tmp_path / "cut.zip", [("archive/data.warc.gz", raw[:-20])])
    with pytest.raises(ValueError, match="cut off"):
        list(warc_zip._blocks(str(tmp_path / "cut.zip"), 1000))
    (tmp_path / "no.zip").write_bytes(b"nothing of the kind")
    with pytest.raises(ValueError, match="not a ZIP"):
        list(warc_zip._blocks(str(tmp_path / "no.zip"), 1000))
    (tmp_path / "empty.zip").write_bytes(b"")
    with pytest.raises(ValueError, match="not a ZIP"):
        list(warc_zip._blocks(str(tmp_path / "empty.zip"), 1000))
    with pytest.raises(ValueError, match="digest"):
        warc_zip.parse_record(RECORDS[20].replace(b"bbbb", b"bbbc", 1))
