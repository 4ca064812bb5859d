"""The whole ingest as a stream: any trigger size, progressive closing, replay."""

import pytest
from pyspark.sql import functions as F

from pressroll.operators.model import organize_stub
from pressroll.plans.ingest import ingest
from pressroll.session import work_dir
from pressroll.sources import files as Fs
from pressroll.streaming import days as Sd

ART = "ordinal long, title string, url string, publishedRaw string"
STAGED = ART + ", date string"
PAGES = [(f"https://x/{i}", f"<p>page {i}</p>") for i in range(60) if i != 7]


def _article(i, day):
    return (i, f"T{i}", f"https://x/{i}", f"Aug {day}, 2026")


def _index(spark):
    return spark.createDataFrame([("2026-08-01", ("k", "e"), ("h", "h"), 1, 0, ["X"])], Fs.INDEX_SCHEMA)


def _run(spark, folders, src, max_files, lateness, closing_files=1, end=True):
    reader = spark.readStream.schema(spark.createDataFrame([], ART).schema).option("maxFilesPerTrigger", max_files)
    base = 1
    Sd.start_arrivals(reader.parquet(src), folders, base).awaitTermination()
    if end:
        Sd.close_feed(spark, folders)
    pages = spark.createDataFrame(PAGES, "url string, html string")
    query = Sd.start_closing(spark, pages, folders, organize_stub, STAGED, lateness, closing_files, rows_per_part=4)
    query.awaitTermination()
    return query


def _feed(spark, batches):
    src = work_dir(spark, "src")
    for rows in batches:
        spark.createDataFrame(rows, ART).coalesce(1).write.mode("append").parquet(src)
    return src


def _stories(df):
    return sorted((r["date"], r["ordinal"], r["url"]) for r in df.collect())


def _entries(df):
    return sorted((r["date"], r["storyCount"], tuple(r["tags"])) for r in df.collect())


@pytest.mark.parametrize("max_files", [1, 100])
def test_equals_the_batch_job(spark, max_files):
    rows = [_article(i, 2 + i % 5) for i in range(40)] + [(50, "old", "https://x/50", "Jul 1, 2026"), (51, "none", "https://x/51", "soon")]
    folders = Sd.Folders(work_dir(spark, "feed"))
    Sd.seed_index(_index(spark), folders)
    _run(spark, folders, _feed(spark, [rows[k::6] for k in range(6)]), max_files, "31 days")
    batch = ingest(spark.createDataFrame(rows, ART), spark.createDataFrame(PAGES, "url string, html string"), _index(spark), organize_stub, rows_per_part=64)
    assert _stories(Sd.stored_stories(spark, folders)) == _stories(batch.stories)
    assert _entries(Sd.index_table(spark, folders).rows()) == _entries(batch.index)
    report = {(r["date"], r["outcome"], r["n_errors"]) for r in spark.read.parquet(folders.report).collect()}
    assert report == {(r["date"], r["outcome"], r["n_errors"]) for r in batch.report.collect()}
    assert {o for _, o, _ in report} == {"added", "error"}


def test_dates_close_as_the_feed_goes_on(spark):
    """In order of dates with a short lateness, each batch closes what it passed,
    and a second start works on the new dates only."""
    folders = Sd.Folders(work_dir(spark, "feed"))
    Sd.seed_index(_index(spark), folders)
    src = _feed(spark, [[_article(i, day) for i in range(10 * k, 10 * k + 4) if i != 7] for k, day in enumerate((10, 12, 14))])
    _run(spark, folders, src, 1, "1 day", end=False)
    assert {d for d, _, _ in _stories(Sd.stored_stories(spark, folders))} == {"2026-08-10", "2026-08-12"}
    versions = Sd.index_table(spark, folders).log.latest()
    # an article for a closed date is late, the others go on
    spark.createDataFrame([_article(40, 10), _article(41, 14), _article(42, 20)], ART).coalesce(1).write.mode("append").parquet(src)
    _run(spark, folders, src, 1, "1 day")
    got = _stories(Sd.stored_stories(spark, folders))
    assert {(d, u) for d, _, u in got if d == "2026-08-10"} == {("2026-08-10", f"https://x/{i}") for i in range(4)}
    assert [u for d, _, u in got if d == "2026-08-14"] == [f"https://x/{i}" for i in (20, 21, 22, 23, 41)]
    changed = [r for r in Sd.index_table(spark, folders).history() if r["version"] > versions]
    assert changed and all(r["info"]["what"] == "close" for r in changed)
    assert _entries(Sd.index_table(spark, folders).rows())[0] == ("2026-08-01", 1, ("X",))


def test_replayed_closing_calls_no_model(spark):
    """The closing checkpoint is lost: everything is done again to the same
    result, out of the stored answers."""
    folders = Sd.Folders(work_dir(spark, "feed"))
    Sd.seed_index(_index(spark), folders)
    src = _feed(spark, [[_article(i, 3 + i % 2) for i in range(6)]])
    _run(spark, folders, src, 1, "31 days")
    first = _stories(Sd.stored_stories(spark, folders)), _entries(Sd.index_table(spark, folders).rows())

    def broken():
        def call(prompt):
            raise AssertionError("called again")
        return call

    lost = Sd.Folders(folders.root)
    object.__setattr__(lost, "closing_checkpoint", work_dir(spark, "other-checkpoint"))
    pages = spark.createDataFrame(PAGES, "url string, html string")
    Sd.start_closing(spark, pages, lost, broken, STAGED, "31 days", 1, rows_per_part=4).awaitTermination()
    assert (_stories(Sd.stored_stories(spark, folders)), _entries(Sd.index_table(spark, folders).rows())) == first
    assert spark.read.parquet(folders.errors).count() == 0


def test_replayed_arrivals_count_once(spark):
    folders = Sd.Folders(work_dir(spark, "feed"))
    Sd.seed_index(_index(spark), folders)
    src = _feed(spark, [[_article(i, 3) for i in range(5)]])
    reader = lambda: spark.readStream.schema(spark.createDataFrame([], ART).schema).parquet(src)
    Sd.start_arrivals(reader(), folders, 1).awaitTermination()
    again = Sd.Folders(folders.root)
    object.__setattr__(again, "arrivals_checkpoint", work_dir(spark, "other-checkpoint"))
    Sd.start_arrivals(reader(), again, 1).awaitTermination()
    got = spark.read.parquet(folders.arrivals)
    assert got.agg(F.sum("n")).first()[0] == 5 and len(got.inputFiles()) == 1
