"""Store integrity rules on own cases."""

import json

from pressroll.operators import integrity as G


def entry(date, story=1, move=0, drop=(), **over):
    e = {"date": date, "dateLabel": {"ko": "k", "en": "e"}, "headline": {"ko": "k", "en": "e"},
         "storyCount": story, "moveCount": move, "tags": ["A"]}
    e.update(over)
    for k in drop:
        e.pop(k)
    return json.dumps(e)


def findings(spark, entries, store_rows):
    ij = spark.createDataFrame([(e,) for e in entries], "entry string")
    store = spark.createDataFrame(store_rows, "date string, storyCount long, moveCount long")
    return sorted((r["rule"], r["date"] or "", r["detail"]) for r in G.check(ij, store).collect())


def test_clean_store(spark):
    assert findings(spark, [entry("2026-08-15"), entry("2026-08-17", 2, 1)],
                    [("2026-08-15", 1, 0), ("2026-08-17", 2, 1)]) == []


def test_each_rule(spark):
    got = findings(spark, [
        entry("2026-08-15", drop=("headline",)),          # missing key
        entry(""),                                         # empty date: checked for keys only
        entry("2026-08-16"),                               # no day
        entry("2026-08-17", story=5),                      # story count differs
        entry("2026-08-18", move="2"),                     # move count not a number: skipped
        entry("2026-08-19", move=3),                       # move count differs
    ], [("2026-08-15", 1, 0), ("2026-08-17", 2, 0), ("2026-08-18", 1, 2), ("2026-08-19", 1, 0),
        ("2026-08-20", 1, 0)])
    assert got == [
        ("missing_detail", "2026-08-16", ""),
        ("missing_key", "2026-08-15", "headline"),
        ("move_count", "2026-08-19", "index 3 vs day 0"),
        ("orphan", "2026-08-20", ""),
        ("story_count", "2026-08-17", "index 5 vs day 2"),
    ]


def test_summary_counts(spark):
    ij = spark.createDataFrame([(entry("2026-08-16"),)], "entry string")
    store = spark.createDataFrame([("2026-08-15", 1, 0)], "date string, storyCount long, moveCount long")
    s = {r["rule"]: r["n"] for r in G.summary(G.check(ij, store), ij).collect()}
    assert s == {"missing_detail": 1, "orphan": 1, "total": 2, "briefings": 1}
