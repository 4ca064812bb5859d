"""Index derivation, upserts and archive queries on own small tables."""

from pyspark.sql import functions as F

from pressroll.operators import index as I

STORY_DDL = "date string, ordinal long, tags array<string>, url string"


def test_first_seen_tags_dedupe(spark):
    stories = spark.createDataFrame(
        [("d", 1, ["A", "B"], None), ("d", 2, ["B", "C"], None), ("d", 3, ["A"], None)], STORY_DDL)
    moves = spark.createDataFrame([], "date string")
    days = spark.createDataFrame([("d", ("k", "e"), ("hk", "he"))],
                                 "date string, dateLabel struct<ko:string,en:string>, headline struct<ko:string,en:string>")
    r = I.index_entries(stories, moves, days).first()
    assert r["tags"] == ["A", "B", "C"] and r["storyCount"] == 3 and r["moveCount"] == 0


def test_first_seen_follows_story_order_not_arrival(spark):
    stories = spark.createDataFrame(
        [("d", 9, ["Z"], None), ("d", 2, ["Y", "Z"], None), ("d", 5, ["X"], None)], STORY_DDL)
    tags = I.ordered_tags(I.first_seen_tags(I.tag_lists(stories, "ordinal"))).first()["tags"]
    assert tags == ["Y", "Z", "X"]


def test_no_join_between_stories_and_their_own_aggregate(spark):
    stories = spark.createDataFrame([("d", 1, ["A"], None)], STORY_DDL)
    plan = I.first_seen_tags(I.tag_lists(stories, "ordinal"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "SortAggregate" not in plan.split("posexplode")[-1]


def test_repeated_keys_land_once(spark):
    index = idx(spark, [("a", 1)])
    new = idx(spark, [("a", 2), ("a", 3), ("b", 4), ("b", 4)])
    assert sorted(I.upsert(index, new).collect()) == [("a", 3), ("b", 4)]
    assert sorted(I.insert_absent(index, new).collect()) == [("a", 1), ("b", 4)]


def test_one_of_two_writers_with_a_valid_token_wins(spark):
    index = idx(spark, [("a", 1)])
    cols = [F.col("date"), F.col("n")]
    token = index.select(I.row_hash(cols)).first()[0]
    upd = spark.createDataFrame([("a", 5, token), ("a", 4, token), ("a", 9, "old"), ("b", 2, None), ("b", 1, "")],
                                "date string, n long, base_sha string")
    result, accepted, rejected = I.versioned_upsert(index, upd, cols, priority=[F.col("n")])
    assert sorted(result.collect()) == [("a", 4), ("b", 1)]
    assert accepted.count() == 2 and rejected.count() == 3


def test_tokens_tell_lists_and_nulls_apart(spark):
    df = spark.createDataFrame([(["A,B"], None), (["A", "B"], None), (["A,B"], "")], "tags array<string>, h string")
    tokens = [r[0] for r in df.select(I.row_hash([F.col("tags"), F.col("h")])).collect()]
    assert len(set(tokens)) == 3


def idx(spark, rows):
    return spark.createDataFrame(rows, "date string, n long")


def test_upsert_insert_replace(spark):
    index = idx(spark, [("2031-05-06", 1), ("2031-05-08", 1)])
    new = idx(spark, [("2031-05-08", 2), ("2031-05-11", 2)])
    assert sorted(I.upsert(index, new).collect()) == sorted(
        [("2031-05-06", 1), ("2031-05-08", 2), ("2031-05-11", 2)])
    assert sorted(I.insert_absent(index, new).collect()) == sorted(
        [("2031-05-06", 1), ("2031-05-08", 1), ("2031-05-11", 2)])
    result, missing = I.replace_existing(index, new)
    assert sorted(result.collect()) == sorted([("2031-05-06", 1), ("2031-05-08", 2)])
    assert missing.collect() == [("2031-05-11", 2)]


def test_versioned_upsert_rejects_stale_token(spark):
    index = idx(spark, [("a", 1), ("b", 1)])
    cols = [F.col("date"), F.col("n")]
    tok_a = index.where("date = 'a'").select(I.row_hash(cols)).first()[0]
    upd = spark.createDataFrame([("a", 2, tok_a), ("b", 2, "stale"), ("c", 2, None), ("d", 2, "x")],
                                "date string, n long, base_sha string")
    result, accepted, rejected = I.versioned_upsert(index, upd, cols)
    assert sorted(result.collect()) == [("a", 2), ("b", 1), ("c", 2)]
    assert sorted(r["date"] for r in rejected.collect()) == ["b", "d"]


def test_archive_filters(spark):
    arch = spark.createDataFrame(
        [(1, "2031-05-06", "Harbour hires a Kicksled pilot", ["NIGHT_SHIFT", "SLED"]),
         (2, "2031-05-08", "Tide table", ["TD"]),
         (3, "2031-06-01", "Town meeting", ["TOWN_MEETING"])],
        "doc_id long, date string, headline string, tags array<string>")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(I.by_tags(arch, ["TD", "SLED"])) == [1, 2]
    assert ids(I.by_tags(arch, ["NIGHT_SHIFT", "SLED"], mode="all")) == [1]
    assert ids(I.search(arch, "kICKs")) == [1]
    assert ids(I.search(arch, "td")) == [2]
    assert ids(I.search(arch, "  ")) == [1, 2, 3]
    assert ids(I.day_lookup(arch, "2031-05-08")) == [2]
    assert [r["month"] for r in I.by_month(arch.withColumn("storyCount", F.lit(1))).orderBy("month").collect()] == \
        ["2031-05", "2031-06"]


def test_story_tag_filter_exact_and_substring(spark):
    st = spark.createDataFrame([("d", 1, ["TOWN"], None), ("d", 2, ["TOWN_MEETING"], None)], STORY_DDL)
    assert [r["ordinal"] for r in I.stories_by_tag(st, "TOWN").collect()] == [1]
    assert sorted(r["ordinal"] for r in I.stories_by_tag(st, "TOWN", mode="substring").collect()) == [1, 2]
    assert I.stories_by_tag(st, "__all__").count() == 2


def test_linked_stories(spark):
    st = spark.createDataFrame([("d", 1, [], "https://x"), ("d", 2, [], ""), ("d", 3, [], None), ("d", 4, [], "  ")],
                               STORY_DDL)
    assert [r["ordinal"] for r in I.linked(st).collect()] == [1]
