"""Postings, tag bitmaps and sketches against the plain operators."""

import random

import pytest
from pyspark.sql import functions as F

from pressroll.operators import bitmaps as Bm
from pressroll.operators import events as Ev
from pressroll.operators import index as I
from pressroll.operators import postings as P
from pressroll.operators import sketches as Sk
from pressroll.session import work_dir

ENTRY = "doc_id long, headline string, tags array<string>"


@pytest.fixture(scope="module")
def archive(spark):
    rng = random.Random(4)
    parts = ["the", "Aaa", "😀é", "x", " ", "\n", "ÜBER", "q#%", "한국어"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(12))), rng.sample(["QB", "OL", "NEWS"], rng.randrange(4))) for i in range(300)]
    rows += [(300, None, ["QB"]), (301, "", []), (302, "ab", None), (303, "long " * 20_000 + "needle", ["OL"])]
    return spark.createDataFrame(rows, ENTRY)


@pytest.fixture(scope="module")
def postings(archive, spark):
    return P.build(archive, P.haystack(), work_dir(spark, "postings"), buckets=8)


@pytest.mark.parametrize("keyword", ["the", "THEAAA", "aaaa", "😀é", "é😀", "über", "x x", "\n", "한국어x", "needle", "g long n", "qb", "none of it", "ab", "q#%", "", " "])
def test_indexed_search_equals_the_scan(archive, postings, keyword):
    expected = {r["doc_id"] for r in I.search(archive, keyword).collect()}
    assert {r["doc_id"] for r in postings.search(archive, P.haystack(), keyword).collect()} == expected


def test_search_reads_its_own_postings_only(archive, postings):
    ids = postings.candidates("needle")
    p = ids._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in p.replace("isnotnull(bucket", "bucket") and "PushedFilters: [" in p and "In(gram" in p
    assert [r["id"] for r in ids.collect()] == [303]
    asked = postings._asked("postings", P.grams_of("needle"))
    assert asked.select("gram").distinct().count() == 4 and asked.count() == 4


def test_short_keywords_have_no_candidates(postings):
    assert postings.candidates("ab") is None and P.grams_of("aaaa") == ["aaa"]


SELECTIONS = [(["QB"], "any"), (["QB", "OL"], "any"), (["QB", "OL"], "all"), (["QB", "OL", "NEWS"], "all"), (["QB", "QB"], "all"),
              (["GONE"], "any"), (["QB", "GONE"], "all"), (["QB", "GONE"], "any"), ([], "any")]


def test_bitmap_selections_equal_the_filters(spark, archive):
    spread = archive.withColumn("doc_id", F.col("doc_id") * 1009)  # several blocks of ids
    chosen = spark.createDataFrame([(k, t, m) for k, (t, m) in enumerate(SELECTIONS)], "selection long, tags array<string>, mode string")
    selected = Bm.select_each(Bm.tag_bitmaps(spread), chosen)
    got = {}
    for r in Bm.ids(selected).collect():
        got.setdefault(r["selection"], []).append(r["doc_id"])
    counts = {r["selection"]: r["n"] for r in Bm.counts(selected).collect()}
    for k, (tags, mode) in enumerate(SELECTIONS):
        expected = sorted(r["doc_id"] for r in I.by_tags(spread, tags, mode).collect()) if tags else []
        assert sorted(got.get(k, [])) == expected and counts.get(k, 0) == len(expected)
    assert Bm.tag_bitmaps(spread).select("block").distinct().count() > 5


def test_bitmap_ids_at_the_edges(spark):
    edges = [0, 1, 7, 8, 9, 32767, 32768, 32769, 65536, 65537, 2**40]
    df = spark.createDataFrame([(i, ["T"]) for i in edges] + [(None, ["T"]), (5, [None])], "doc_id long, tags array<string>")
    chosen = spark.createDataFrame([("s", ["T"], "all")], "selection string, tags array<string>, mode string")
    assert sorted(r["doc_id"] for r in Bm.ids(Bm.select_each(Bm.tag_bitmaps(df), chosen)).collect()) == edges


def test_merged_sketches_keep_the_bound(spark):
    """Users overlap between days; a month's estimate comes from the days alone."""
    events = spark.range(120_000).selectExpr(
        "concat('u', pmod(xxhash64(id), 9000 * (1 + id % 3))) AS user", "id % 4 AS k",
        "timestamp'2026-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 90 AS int)) AS ts").withColumn("name", F.concat(F.lit("e"), "k"))
    days = Sk.daily(events)
    exact = events.groupBy(F.date_trunc("month", F.to_date("ts")).alias("span"), "name").agg(F.count_distinct("user").alias("n_users"))
    rows = Sk.measured(Sk.merged(days, F.date_trunc("month", F.col("day"))), exact).collect()
    assert len(rows) == 12 and all(r["in_bound"] for r in rows) and max(r["n_users"] for r in rows) > 5000
    daily = {(r["window_start"].date(), r["name"]): r["n_events"] for r in Ev.usage(events).collect()}
    assert {(r["day"], r["name"]): r["n_events"] for r in days.collect()} == daily


def test_a_wrong_estimate_is_told(spark):
    rows = spark.createDataFrame([("s", "a", 1000), ("s", "b", 3)], "span string, name string, n_users_estimate long")
    exact = spark.createDataFrame([("s", "a", 900), ("s", "b", 3)], "span string, name string, n_users long")
    assert {r["name"]: r["in_bound"] for r in Sk.measured(rows, exact).collect()} == {"a": False, "b": True}
