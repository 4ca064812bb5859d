"""Repair edits: delete by literal (flat and nested), literal replace."""

from pyspark.sql import functions as F

from pressroll.operators import repair as R


def test_delete_matching_treats_missing_text_as_empty(spark):
    rows = spark.createDataFrame([(1, ("모래 언덕 영입", "x")), (2, ("다른 소식", "y")), (3, None)],
                                 "k int, title struct<ko:string,en:string>")
    kept = R.delete_matching(rows, F.col("title.ko"), "모래 언덕")
    assert sorted(r["k"] for r in kept.collect()) == [2, 3]


def test_delete_nested_inside_a_day_row(spark):
    day = spark.createDataFrame(
        [("2031-05-06", [(("모래 언덕 방출", "Dune"),), (("등대 점등", "Lamp"),), ((None, "no ko"),)])],
        "date string, stories array<struct<title:struct<ko:string,en:string>>>")
    out = day.select(R.delete_nested(F.col("stories"), ["title", "ko"], "모래 언덕").alias("s")).first()["s"]
    assert [x["title"]["en"] for x in out] == ["Lamp", "no ko"]


def test_replace_in_documents_flags_changes(spark):
    docs = spark.createDataFrame([(1, "경기는 정오 무렵"), (2, "no match")], "id int, text string")
    out = {r["id"]: (r["text"], r["changed"]) for r in
           R.replace_in_documents(docs, "text", [("정오 무렵", "오후 두시")]).collect()}
    assert out == {1: ("경기는 오후 두시", True), 2: ("no match", False)}


def test_days_emptied_by_an_edit_are_refused(spark):
    ddl = "date string, storyCount long, tags array<string>"
    old = spark.createDataFrame([("a", 3, ["X"]), ("b", 1, ["Y"]), ("c", 2, ["Z"])], ddl)
    edited = spark.createDataFrame([("a", 2, ["X"]), ("b", 0, [])], ddl)
    out = {r["date"]: (r["storyCount"], r["tags"], r["outcome"]) for r in R.refuse_emptied(old, edited).collect()}
    assert out == {"a": (2, ["X"], "edited"), "b": (1, ["Y"], "refused"), "c": (2, ["Z"], "refused")}


def _day(**more):
    import json

    bi = {"ko": "가", "en": "a"}
    story = {"icon": "i", "status": "NEW", "tags": ["T"], "title": bi, "facts": {"ko": ["가"], "en": ["a"]}, "interp": bi}
    return json.dumps({"date": "2026-01-01", "dateLabel": bi, "headline": bi, "stories": [story], "injuries": [], "moves": [], "schedule": []} | more,
                      ensure_ascii=False)


def test_an_edit_that_breaks_a_document_is_refused(spark):
    """Fine, untouched, broken by the edit, broken before and touched, cut off by the edit."""
    docs = {1: _day(headline={"ko": "old", "en": "x"}), 2: _day(), 3: _day(headline={"ko": "gone", "en": "x"}), 4: _day(stories=[], date="old"),
            5: _day(headline={"ko": "quote", "en": "x"}), 6: None}
    df = spark.createDataFrame(list(docs.items()), "id int, raw string")
    out = {r["id"]: r for r in R.replace_validated(df, "raw", [("old", "new"), ("gone", " "), ("quote", '"')]).collect()}
    assert {k: r["outcome"] for k, r in out.items()} == {1: "edited", 2: "unchanged", 3: "refused", 4: "refused", 5: "refused", 6: "unchanged"}
    assert out[1]["raw"] == docs[1].replace("old", "new") and all(out[k]["raw"] == docs[k] for k in (2, 3, 4, 5, 6))
    assert out[3]["errors"] and out[4]["errors"] and out[5]["errors"] and not out[1]["errors"]


def test_nested_delete_refuses_an_empty_day(spark):
    ddl = "date string, stories array<struct<title:struct<ko:string,en:string>>>, moves array<struct<text:struct<ko:string,en:string>>>"
    x, y, none = (("모래", "x"),), (("등대", "y"),), ((None, "z"),)
    days = spark.createDataFrame([("a", [x, y, none], [x]), ("b", [x, x], [x, y]), ("c", [y], []), ("d", [y], [x]), ("e", [], [x])], ddl)
    out = {r["date"]: r for r in R.delete_validated(days, {"stories": ["title", "ko"], "moves": ["text", "ko"]}, "모래").collect()}
    got = {k: (r["outcome"], r["n_deleted"], len(r["stories"]), len(r["moves"])) for k, r in out.items()}
    assert got == {"a": ("edited", 2, 2, 0), "b": ("refused", 3, 2, 2), "c": ("unchanged", 0, 1, 0), "d": ("edited", 1, 1, 0), "e": ("refused", 1, 0, 1)}
