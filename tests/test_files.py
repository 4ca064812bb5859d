"""Store readers and writers."""

import os

import pytest
from pyspark.sql import functions as F

from pressroll.session import local_path, work_dir
from pressroll.sources import files as Fs


def test_scan_json_files_flat_without_index(spark):
    root = local_path(work_dir(spark, "jsonfiles"))
    os.makedirs(os.path.join(root, "schedule"))
    for name, text in [("2026-08-15.json", '{"date": "2026-08-15"}'), ("index.json", "[]"),
                       ("notes.txt", "x"), ("bad.json", "{oops")]:
        with open(os.path.join(root, name), "w") as f:
            f.write(text)
    with open(os.path.join(root, "schedule", "2026.json"), "w") as f:
        f.write("{}")
    got = sorted((r["stem"], r["text"]) for r in Fs.scan_json_files(spark, root).collect())
    assert got == [("2026-08-15", '{"date": "2026-08-15"}'), ("bad", "{oops")]


def test_scan_index_missing(spark):
    root = work_dir(spark, "nothing")
    assert Fs.scan_index(spark, root).count() == 0
    with pytest.raises(FileNotFoundError):
        Fs.scan_index(spark, root, missing="error")


def test_dynamic_overwrite_replaces_only_written_days(spark):
    root = work_dir(spark, "days")
    rows = spark.createDataFrame([("2026-08-15", 1), ("2026-08-15", 2), ("2026-08-17", 3)], "date string, k long")
    Fs.write_days(rows, root)
    Fs.write_days(spark.createDataFrame([("2026-08-15", 9)], "date string, k long"), root)
    got = sorted((r["date"], r["k"]) for r in Fs.read_days(spark, root).collect())
    assert got == [("2026-08-15", 9), ("2026-08-17", 3)]
    assert sorted(r["date"] for r in Fs.list_day_files(spark, root).collect()) == ["2026-08-15", "2026-08-17"]


def test_partition_filter_reaches_scan(spark):
    root = work_dir(spark, "days2")
    Fs.write_days(spark.createDataFrame([("2026-08-15", 1), ("2026-08-17", 3)], "date string, k long"), root)
    plan = Fs.read_days(spark, root).where(F.col("date") == "2026-08-17")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "2026-08-17" in plan


def test_index_round_trip_and_order(spark):
    root = work_dir(spark, "index")
    idx = spark.createDataFrame(
        [("2026-08-15", ("k", "e"), ("hk", "he"), 1, 0, ["A"]), ("2026-08-17", ("k", "e"), ("hk", "he"), 2, 1, ["B"])],
        Fs.INDEX_SCHEMA)
    Fs.write_index(idx, root)
    back = Fs.scan_index(spark, root)
    assert sorted(r["date"] for r in back.collect()) == ["2026-08-15", "2026-08-17"]


def test_json_file_folder_through_validation(spark):
    """The site's own layout: a flat folder of <date>.json files, validated."""
    import json

    from pressroll.operators import validate as Vd
    from tests_support_days import GOOD_DAY

    root = local_path(work_dir(spark, "site"))
    os.makedirs(root)
    with open(os.path.join(root, "2026-08-15.json"), "w") as f:
        json.dump(GOOD_DAY, f, ensure_ascii=False, indent=2)
    bad = dict(GOOD_DAY, headline="only text")
    with open(os.path.join(root, "2026-08-16.json"), "w") as f:
        json.dump(bad, f, ensure_ascii=False)
    with open(os.path.join(root, "2026-08-17.json"), "w") as f:
        f.write("{ truncated")
    files = Fs.scan_json_files(spark, root)
    checked = Vd.with_errors(Vd.parse_days(files, "text"))
    got = {r["stem"]: (r["doc"] is not None, None if r["doc"] is None else len(r["errors"])) for r in checked.collect()}
    assert got == {"2026-08-15": (True, 0), "2026-08-16": (True, 1), "2026-08-17": (False, None)}


def write_text(root, name, text):
    os.makedirs(root, exist_ok=True)
    with open(os.path.join(root, name), "w") as f:
        f.write(text)


def test_index_array_forms(spark):
    import json

    import pytest

    entry = {"date": "2031-05-06", "dateLabel": {"ko": "k", "en": "e"}, "headline": {"ko": "h", "en": "i"}, "storyCount": 2, "moveCount": 0, "tags": ["A"]}
    root = local_path(work_dir(spark, "array"))
    write_text(root, "index.json", json.dumps([entry, dict(entry, date="2031-05-07", tags=[])], indent=2))
    assert sorted((r["date"], r["storyCount"], r["tags"]) for r in Fs.scan_index_array(spark, root).collect()) == [
        ("2031-05-06", 2, ["A"]), ("2031-05-07", 2, [])]
    with pytest.raises(FileNotFoundError):
        Fs.scan_index_array(spark, root + "-none")
    for name, text, message in (("broken", json.dumps([entry])[:-4], "does not parse"), ("object", json.dumps(entry), "is not an array")):
        write_text(f"{root}-{name}", "index.json", text)
        with pytest.raises(Exception, match=message):
            Fs.scan_index_array(spark, f"{root}-{name}").collect()


def test_printed_season_file(spark):
    import json

    game = {"phase": "reg", "week": 4, "opponent": "Owls", "home": True, "dateKST": "2031-10-06T09:20:00+09:00"}
    root = local_path(work_dir(spark, "season"))
    write_text(root, "2031.json", json.dumps({"season": 2031, "gb": [game, dict(game, week=5)], "min": [dict(game, home=False)]}, indent=2))
    games = Fs.scan_season(spark, root, multi_line=True).collect()
    assert sorted((r["team"], r["season"], r["i"], r["week"], r["home"]) for r in games) == [
        ("GB", 2031, 0, 4, True), ("GB", 2031, 1, 5, True), ("MIN", 2031, 0, 4, False)]


def test_index_file_is_ordered(spark):
    root = work_dir(spark, "ordered")
    rows = [(f"2031-05-{d:02d}", ("k", "e"), ("h", "h"), 1, 0, []) for d in (9, 3, 28, 17)]
    Fs.write_index(spark.createDataFrame(rows, Fs.INDEX_SCHEMA), root)
    parts = sorted(f for f in os.listdir(local_path(root)) if f.startswith("part"))
    lines = [line for f in parts for line in open(os.path.join(local_path(root), f))]
    assert [x[9:19] for x in lines] == ["2031-05-28", "2031-05-17", "2031-05-09", "2031-05-03"]


def test_a_date_is_one_folder(spark):
    """Looking up a date reads its partition alone."""
    from pressroll.operators import index as I

    root = work_dir(spark, "stories")
    Fs.write_days(spark.createDataFrame([(f"2026-01-{k:02d}", k) for k in range(1, 29)], "date string, k long"), root)
    found = I.day_lookup(Fs.read_days(spark, root), "2026-01-07")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "DataFilters: []" in plan
    assert [r["k"] for r in found.collect()] == [7]
