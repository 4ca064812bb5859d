"""Maintained summaries equal a full derivation after random edits."""

import random

from pyspark.sql import functions as F

from pressroll.operators import index as I
from pressroll.operators.maintain import Summaries
from pressroll.session import work_dir

STORY = "date string, ordinal long, tags array<string>"
TEXT = "struct<ko:string,en:string>"


def _store(spark, model):
    stories = [(d, k, tags) for d, (lists, _) in model.items() for k, tags in enumerate(lists)]
    moves = [(d,) for d, (_, n) in model.items() for _ in range(n)]
    days = [(d, ("ko " + d, "en"), ("h", str(len(lists)))) for d, (lists, _) in model.items()]
    return (spark.createDataFrame(stories, STORY), spark.createDataFrame(moves, "date string"),
            spark.createDataFrame(days, f"date string, dateLabel {TEXT}, headline {TEXT}"))


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _check(spark, summaries, model):
    stories, moves, days = _store(spark, model)
    entries = I.index_entries(stories, moves, days)
    assert _rows(summaries.entries.rows().select(*I.INDEX_COLUMNS)) == _rows(entries.select(*I.INDEX_COLUMNS))
    assert _rows(summaries.months.rows()) == _rows(I.by_month(entries))
    assert _rows(summaries.tags.rows()) == _rows(I.tag_vocabulary(stories))


def test_random_edits(spark):
    rng = random.Random(11)
    summaries, model = Summaries(spark, work_dir(spark, "summaries")), {}
    summaries.create()
    _check(spark, summaries, model)
    for step in range(4):
        dates = {f"2026-{rng.randint(1, 4):02d}-{rng.randint(1, 28):02d}" for _ in range(12)} | ({"2027-01-01"} if step % 2 else set())
        change = {d: ([rng.sample("ABCDEZ", rng.randrange(4)) for _ in range(rng.randrange(4))], rng.randrange(3)) for d in sorted(dates) if rng.random() < 0.7}
        if step == 3:  # a month that ends up empty, and a tag that does
            dates, change = set(model), {d: ([["A"]], 0) for d in model if d < "2026-04"}
        summaries.apply(spark.createDataFrame([(d,) for d in dates], "date string"), *_store(spark, change))
        model = {d: v for d, v in model.items() if d not in dates} | change
        _check(spark, summaries, model)


def test_a_change_rewrites_its_months_only(spark):
    summaries = Summaries(spark, work_dir(spark, "summaries"))
    summaries.create()
    model = {f"2026-{m:02d}-01": ([["A"]], 1) for m in range(1, 13)}
    summaries.apply(spark.createDataFrame([(d,) for d in model], "date string"), *_store(spark, model))
    before = {n: t.log.read(t.log.latest())["parts"] for n, t in vars(summaries).items() if n != "spark"}
    summaries.apply(spark.createDataFrame([("2026-03-01",)], "date string"), *_store(spark, {"2026-03-01": ([["A"], ["B"]], 0)}))
    after = {n: t.log.read(t.log.latest())["parts"] for n, t in vars(summaries).items() if n != "spark"}
    changed = {n: {p for p in after[n] if after[n][p] != before[n].get(p)} for n in after}
    assert changed == {"entries": {"2026-03"}, "date_tags": {"2026-03"}, "months": {"2026"}, "tags": {"B"}}
    assert _rows(summaries.tags.rows()) == [("A", 12), ("B", 1)]
    read = summaries.entries.begin().read(["2026-03"])
    assert len(read.inputFiles()) == 1 and read.agg(F.sum("storyCount")).first()[0] == 2
