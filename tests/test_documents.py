"""Day-document validators over VARIANT."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from pressroll.functions import documents as V

GOLDEN = {
    "date": "2031-03-04",
    "dateLabel": {"ko": "2031-03-04 (현지)", "en": "Mar 4, 2031 (local)"},
    "headline": {"ko": "오늘의 소식", "en": "Today's news"},
    "stories": [
        {"icon": "🌊", "status": "CONFIRMED", "tags": ["HARBOUR", "TIDE"],
         "title": {"ko": "제목", "en": "Title"},
         "facts": {"ko": ["하나", "둘"], "en": ["one", "two"]},
         "interp": {"ko": "해설", "en": "Why it matters"}},
        {"icon": "🛠", "status": "UPCOMING", "tags": ["REPAIR"],
         "title": {"ko": "부상", "en": "Injury"},
         "facts": {"ko": ["무릎"], "en": ["knee"]},
         "interp": {"ko": "주의", "en": "Watch"}, "url": "/harbour/7"},
    ],
    "injuries": [{"player": {"ko": "선수", "en": "Player"}, "issue": {"ko": "무릎", "en": "Knee"},
                  "status": {"ko": "주의", "en": "Questionable"}, "watch": True}],
    "moves": [{"date": "03-02", "text": {"ko": "영입", "en": "Joined"}}],
    "schedule": [{"date": {"ko": "3월 9일\n(일)", "en": "Mar 9\n(Sun)"}, "text": {"ko": "경기", "en": "Game"}}],
}


def errors(spark, doc, raw=None):
    text = raw if raw is not None else json.dumps(doc, ensure_ascii=False)
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(V.day_errors(F.parse_json("t")).alias("e")).first()["e"]


def story_errors(spark, story):
    df = spark.createDataFrame([(json.dumps(story, ensure_ascii=False),)], "t string")
    return df.select(V.story_errors(F.parse_json("t")).alias("e")).first()["e"]


def mutate(fn):
    d = copy.deepcopy(GOLDEN)
    fn(d)
    return d


def test_golden_day_is_valid(spark):
    assert errors(spark, GOLDEN) == []


def test_many_missing_story_fields(spark):
    errs = story_errors(spark, {"status": "\t", "tags": ["A", " "], "title": {"ko": "가"}, "facts": {"ko": [], "en": []}, "interp": 3})
    assert errs == [V.MSG_STORY_ICON, V.MSG_STORY_STATUS, V.MSG_STORY_TAGS, V.MSG_STORY_TITLE, V.MSG_STORY_FACTS, V.MSG_STORY_INTERP]


def test_unequal_fact_lists(spark):
    d = mutate(lambda d: d["stories"][0]["facts"]["en"].pop())
    assert errors(spark, d) == ["stories[0]: " + V.MSG_STORY_FACTS]


@pytest.mark.parametrize("url,ok", [("/a/b", True), ("\u3000", False), (0.5, False), (None, False), (["/a"], False)])
def test_url_rules(spark, url, ok):
    story = copy.deepcopy(GOLDEN["stories"][0])
    story["url"] = url
    assert (story_errors(spark, story) == []) == ok
    if not ok:
        assert story_errors(spark, story) == [V.MSG_STORY_URL]


def test_url_absent_is_fine(spark):
    assert story_errors(spark, GOLDEN["stories"][0]) == []


def test_watch_must_be_boolean(spark):
    d = mutate(lambda d: d["injuries"][0].update(watch=1))
    assert errors(spark, d) == ["injuries[0]: " + V.MSG_INJURY_WATCH]


def test_bad_dates(spark):
    assert errors(spark, mutate(lambda d: d.update(date="4.3.2031"))) == [V.MSG_DAY_DATE]
    assert errors(spark, mutate(lambda d: d.update(date="2031-03-04\n"))) == [V.MSG_DAY_DATE]


def test_no_stories_and_empty_side_lists(spark):
    assert errors(spark, mutate(lambda d: d.update(stories=[]))) == [V.MSG_DAY_STORIES]
    assert errors(spark, mutate(lambda d: d.update(injuries=[], moves=[], schedule=[]))) == []
    assert errors(spark, mutate(lambda d: d.pop("moves"))) == [V.MSG_DAY_MOVES]


def test_monolingual_document(spark):
    def mono(d):
        d["dateLabel"] = "4 March"
        d["headline"] = "High water"
        d["stories"][0]["title"] = "High water again"
        d["stories"][0]["facts"] = ["two metres", "three hours"]
        d["stories"][0]["interp"] = "A storm is near"
        d["injuries"][0]["player"] = "Keeper"
        d["schedule"][0]["date"] = "9 March"
    errs = errors(spark, mutate(mono))
    assert errs == [V.MSG_DAY_LABEL, V.MSG_DAY_HEADLINE,
                    "stories[0]: " + V.MSG_STORY_TITLE, "stories[0]: " + V.MSG_STORY_FACTS,
                    "stories[0]: " + V.MSG_STORY_INTERP, "injuries[0]: " + V.MSG_INJURY_PLAYER,
                    "schedule[0]: " + V.MSG_SCHEDULE_DATE]


def test_non_objects(spark):
    assert errors(spark, None, raw="[1, 2]")[0] == V.MSG_DAY_DATE  # an array passes the object guard
    assert errors(spark, None, raw='"text"') == [V.MSG_DAY_NOT_OBJECT]
    assert errors(spark, None, raw="null") == [V.MSG_DAY_NOT_OBJECT]
    d = mutate(lambda d: d["stories"].append("oops"))
    assert errors(spark, d) == ["stories[2]: " + V.MSG_STORY_NOT_OBJECT]


def test_duplicate_key_last_wins_in_validation(spark):
    raw = json.dumps(GOLDEN, ensure_ascii=False).replace('"icon": "🌊"', '"icon": "🌊", "icon": ""', 1)
    assert errors(spark, None, raw=raw) == ["stories[0]: " + V.MSG_STORY_ICON]


def test_missing_keys_in_order(spark):
    df = spark.createDataFrame([('{"date": "x", "tags": null}',)], "t string")
    got = df.select(V.missing_keys(F.parse_json("t"), V.INDEX_KEYS).alias("m")).first()["m"]
    assert got == ["dateLabel", "headline", "storyCount", "moveCount"]
