"""The flat folder of JSON files as a data source, and the report over it."""

import json
import os

import pytest

from pressroll.operators import integrity as G
from pressroll.session import work_dir
from pressroll.sources import files as Fs
from pressroll.sources import json_store as Js

DAY = {"date": "2026-01-01", "dateLabel": {}, "headline": {}, "stories": [1, 2], "injuries": [], "moves": [1], "schedule": []}
ENTRY = {"date": "2026-01-01", "dateLabel": {}, "headline": {}, "storyCount": 2, "moveCount": 1, "tags": []}


def _put(folder, files):
    os.makedirs(folder, exist_ok=True)
    for name, content in files.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(content if isinstance(content, bytes) else json.dumps(content).encode())


def test_only_the_day_files_are_listed(spark, tmp_path):
    _put(tmp_path, {"2026-01-01.json": DAY, "index.json": [], "notes.txt": b"x", "a b#%.json": {}})
    _put(tmp_path / "schedule", {"2026.json": {}})
    _put(tmp_path / "odd.json", {"inner.json": {}})
    got = Js.scan(spark, str(tmp_path)).orderBy("file").collect()
    assert [(r["file"], r["stem"], r["error"]) for r in got] == [("2026-01-01.json", "2026-01-01", None), ("a b#%.json", "a b#%", None)]
    assert json.loads(got[0]["text"]) == DAY and got[0]["size"] == len(json.dumps(DAY))


def test_unreadable_files_are_rows(tmp_path):
    """A file that is gone by the time it is read; bytes that are no UTF-8."""
    _put(tmp_path, {"a.json": b"\xff{}", "empty.json": b"", "gone.json": DAY})
    reader = Js.JsonStoreReader({"path": str(tmp_path)})
    (partition,) = reader.partitions()
    os.remove(tmp_path / "gone.json")
    got = {r["stem"]: (r["text"], r["error"]) for batch in reader.read(partition) for r in batch.to_pylist()}
    assert got["a"] == ("\ufffd{}", None) and got["empty"] == ("", None)
    assert got["gone"][0] is None and "FileNotFoundError" in got["gone"][1]


def test_listing_opens_nothing(spark, tmp_path):
    _put(tmp_path, {"a.json": DAY, "gone.json": DAY})
    assert {r["stem"] for r in Js.listing(spark, str(tmp_path)).collect()} == {"a", "gone"}
    reader = Js.JsonStoreReader({"path": str(tmp_path), "content": "false"})
    (partition,) = reader.partitions()
    os.remove(tmp_path / "gone.json")
    rows = [r for batch in reader.read(partition) for r in batch.to_pylist()]
    assert [(r["stem"], r["text"], r["error"]) for r in rows] == [("a", None, None), ("gone", None, None)]


def test_files_are_dealt_by_bytes_and_number(spark, tmp_path):
    assert Js.grouped([("a", 5), ("b", 5), ("c", 50), ("d", 1), ("e", 1), ("f", 1)], 10, 2) == [
        [("a", 5), ("b", 5)], [("c", 50)], [("d", 1), ("e", 1)], [("f", 1)]]
    _put(tmp_path, {f"{i}.json": DAY for i in range(50)})
    df = Js.scan(spark, str(tmp_path), partitionFiles=7)
    assert df.rdd.getNumPartitions() == 8 and df.count() == 50


def test_empty_folder(spark, tmp_path):
    assert Js.scan(spark, str(tmp_path)).count() == 0


def test_write_and_scan_again(spark):
    folder = work_dir(spark, "store")
    docs = spark.createDataFrame([("a", '{"x":"ü"}'), ("b", None)], "stem string, content string")
    for _ in range(2):  # a repeated task writes the same files
        assert {tuple(r) for r in Js.write(docs, folder).collect()} == {("a.json", 10), ("b.json", 0)}
    assert {(r["stem"], r["text"]) for r in Js.scan(spark, folder).collect()} == {("a", '{"x":"ü"}'), ("b", "")}
    assert sorted(os.listdir(Js.open_store(folder)[1])) == ["a.json", "b.json"]


def _report(spark, tmp_path, entries, files):
    _put(tmp_path / "index", {"index.json": entries})
    _put(tmp_path, files)
    found = G.report(Fs.scan_index_raw(spark, str(tmp_path / "index")), Js.scan(spark, str(tmp_path)))
    return sorted(((r["rule"], r["date"], r["detail"], r["n"]) for r in found.collect()), key=str)


def test_clean_store_has_no_findings(spark, tmp_path):
    assert _report(spark, tmp_path, [ENTRY], {"2026-01-01.json": DAY}) == []


def test_each_rule(spark, tmp_path):
    def entry(n, **more):
        return ENTRY | {"date": f"2026-01-{n:02d}"} | more

    def day(n, **more):
        return DAY | {"date": f"2026-01-{n:02d}"} | more

    bare = {k: v for k, v in entry(2).items() if k not in ("tags", "headline")}
    no_moves = {k: v for k, v in day(5).items() if k != "moves"}
    entries = [entry(1), bare, entry(3), entry(4), entry(5), entry(6), entry(7, storyCount=3, moveCount=5), entry(8, storyCount="3", moveCount=None),
               entry(9), entry(9), {"date": ""}, {}, entry(10, dateLabel=None), entry(12), entry(13)]
    files = {"2026-01-02.json": day(2), "2026-01-03.json": b"{", "2026-01-04.json": b"null", "2026-01-05.json": no_moves, "2026-01-06.json": day(7),
             "2026-01-07.json": day(7), "2026-01-08.json": day(8), "2026-01-09.json": day(9, stories=[], moves={}), "2026-01-10.json": day(10, stories=None),
             "2026-01-11.json": b"{ not judged", "2026-01-12.json": b"[]", "2026-01-13.json": day(13, date=None)}
    os.makedirs(tmp_path, exist_ok=True)
    lacks = [("missing_key", "", k, 1) for k in ENTRY if k != "date"] + [("missing_key", None, k, 1) for k in ENTRY]
    assert _report(spark, tmp_path, entries, files) == sorted([
        ("missing_detail", "2026-01-01", "", 1), ("missing_key", "2026-01-02", "headline", 1), ("missing_key", "2026-01-02", "tags", 1),
        ("detail_parse", "2026-01-03", "", 1), ("detail_missing_key", "2026-01-05", "moves", 1), ("detail_date", "2026-01-06", "2026-01-07", 1),
        ("story_count", "2026-01-07", "index 3 vs day 2", 1), ("move_count", "2026-01-07", "index 5 vs day 1", 1),
        ("story_count", "2026-01-09", "index 2 vs day 0", 2), ("orphan", "2026-01-11", "", 1), *lacks,
        *[("detail_missing_key", "2026-01-12", k, 1) for k in DAY]], key=str)


def test_unreadable_document_is_reported(spark, tmp_path):
    _put(tmp_path / "index", {"index.json": [ENTRY]})
    files = spark.createDataFrame([("2026-01-01", None, "PermissionError: no")], "stem string, text string, error string")
    found = G.report(Fs.scan_index_raw(spark, str(tmp_path / "index")), files)
    assert [tuple(r) for r in found.collect()] == [("unreadable", "2026-01-01", "", 1)]


@pytest.mark.parametrize("index, said", [(b"{", "does not parse"), (b'{"date":1}', "not an array")])
def test_a_broken_index_stops_the_report(spark, tmp_path, index, said):
    with pytest.raises(Exception, match=said):
        _report(spark, tmp_path, index, {"2026-01-01.json": DAY})


def test_a_missing_index_stops_the_report(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        G.report(Fs.scan_index_raw(spark, str(tmp_path / "none")), Js.scan(spark, str(tmp_path)))
