"""Ingest job, model step and the streaming ingest (late data, replay)."""

from pyspark.sql import functions as F

from pressroll.operators.model import apply_model
from pressroll.session import work_dir
from pressroll.sources import files as Fs
from pressroll.streaming import ingest as Si

ART = "ordinal long, title string, url string, publishedRaw string"


def test_model_errors_are_per_row(spark):
    def factory():
        def call(p):
            if "bad" in p:
                raise ValueError("model refused")
            return p.upper()
        return call
    df = spark.createDataFrame([("ok",), ("bad",)], "prompt string")
    got = {r["prompt"]: (r["response"], r["model_error"]) for r in apply_model(df, "prompt", factory).collect()}
    assert got == {"bad": (None, "ValueError: model refused"), "ok": ("OK", None)}


def write_batch(spark, rows, folder, name):
    spark.createDataFrame(rows, ART).coalesce(1).write.mode("append").parquet(folder)


def test_stream_ingest_batches_late_data_and_replay(spark):
    src, root, ck = work_dir(spark, "art"), work_dir(spark, "idx"), work_dir(spark, "ck")
    Si.seed_index(spark.createDataFrame(
        [("2026-08-14", ("k", "e"), ("h", "h"), 1, 0, ["X"])], Fs.INDEX_SCHEMA), root)
    schema = spark.createDataFrame([], ART).schema
    write_batch(spark, [(1, "A", "/1", "Aug 15, 2026"), (2, "B", "/2", "Aug 16, 2026"),
                        (3, "C", "/3", "Aug 13, 2026"), (4, "D", "/4", "nonsense")], src, "b1")
    Si.start(spark, src, schema, root, ck).awaitTermination()
    v1 = {r["date"]: r["storyCount"] for r in Si.read_index_version(spark, root).collect()}
    assert v1 == {"2026-08-14": 1, "2026-08-15": 1, "2026-08-16": 1}
    # a later file: an article for a saved date is late and dropped
    write_batch(spark, [(5, "E", "/5", "Aug 16, 2026"), (6, "F", "/6", "Aug 18, 2026")], src, "b2")
    Si.start(spark, src, schema, root, ck).awaitTermination()
    v2 = {r["date"]: r["storyCount"] for r in Si.read_index_version(spark, root).collect()}
    assert v2 == {"2026-08-14": 1, "2026-08-15": 1, "2026-08-16": 1, "2026-08-18": 1}
    # replaying the same input from a fresh checkpoint against the seed gives the same index
    root2, ck2 = work_dir(spark, "idx"), work_dir(spark, "ck")
    Si.seed_index(spark.createDataFrame(
        [("2026-08-14", ("k", "e"), ("h", "h"), 1, 0, ["X"])], Fs.INDEX_SCHEMA), root2)
    Si.start(spark, src, schema, root2, ck2).awaitTermination()
    v3 = {r["date"]: r["storyCount"] for r in Si.read_index_version(spark, root2).collect()}
    assert v3 == {"2026-08-14": 1, "2026-08-15": 1, "2026-08-16": 2, "2026-08-18": 1}


def test_ingest_job_on_small_feed(spark):
    from pressroll.operators.model import organize_stub
    from pressroll.plans.ingest import ingest

    feed = spark.createDataFrame(
        [(1, "A", "https://x/1", "Aug 15, 2026"), (2, "B", "https://x/2", "Aug 15, 2026"),
         (3, "C", "https://x/gone", "Aug 16, 2026"), (4, "D", "https://x/4", "Aug 1, 2020")], ART)
    pages = spark.createDataFrame([("https://x/1", "<p>one</p>"), ("https://x/2", "<p>two</p>"),
                                   ("https://x/4", "<p>old</p>")], "url string, html string")
    index = spark.createDataFrame([("2026-08-01", ("k", "e"), ("h", "h"), 1, 0, ["X"])], Fs.INDEX_SCHEMA)
    res = ingest(feed, pages, index, organize_stub)
    report = {r["date"]: (r["outcome"], r["n_errors"], r["checked_articles"]) for r in res.report.collect()}
    assert report == {"2026-08-15": ("added", 0, 3), "2026-08-16": ("error", 1, 3)}
    new = {r["date"]: (r["storyCount"], r["tags"]) for r in res.index.collect()}
    assert new == {"2026-08-01": (1, ["X"]), "2026-08-15": (2, ["NEWS", "WEB"])}
    errors = [(r["date"], r["message"]) for r in res.errors.collect()]
    assert len(errors) == 1 and errors[0][0] == "2026-08-16" and errors[0][1].startswith("stories[0]: ")


def test_part_size_does_not_matter(spark):
    from pressroll.plans.ingest import ingest

    def picky_model():
        """Finds stories only in every third article; answers nothing else."""
        import json
        import re

        def call(prompt):
            urls = [u for u in re.findall(r"^URL: (.*)$", prompt, re.M) if int(u.rsplit("/", 1)[1]) % 3 == 0]
            both = {"ko": "가", "en": "a"}
            stories = [{"icon": "i", "status": "NEW", "tags": [f"T{int(u.rsplit('/', 1)[1]) % 7}"], "title": both,
                        "facts": {"ko": ["가"], "en": ["a"] * (2 if u.endswith("/33") else 1)}, "interp": both, "url": u} for u in urls]
            moves = [{"date": "05-06", "text": both}] if any(u.endswith("/3") for u in urls) else 0
            return json.dumps({"headline": both, "stories": stories, "moves": moves, "injuries": None})
        return call

    rows = [(k, f"T{k}", f"https://x/{k}", "May 6, 2031" if k < 30 else "May 7, 2031") for k in range(1, 41)]
    feed = spark.createDataFrame(rows, ART)
    pages = feed.select("url", F.concat(F.lit("<p>"), "title").alias("html"))
    index = spark.createDataFrame([], Fs.INDEX_SCHEMA)
    seen = []
    for size in (2, 7, 1000):
        res = ingest(feed, pages, index, picky_model, rows_per_part=size, model_tasks=3, store=work_dir(spark, "days"))
        assert len(res.responses.inputFiles()) > 1 or size == 1000
        seen.append((sorted(map(str, res.index.collect())), sorted(map(str, res.report.collect())), sorted(map(str, res.errors.collect())),
                     sorted(map(str, res.stories.collect())), sorted(map(str, res.rows["moves"].collect())), res.rows["injuries"].count()))
    assert seen[0] == seen[1] == seen[2]
    assert "added" in seen[0][1][0] and "error" in seen[0][1][1] and len(seen[0][3]) == 9 and len(seen[0][4]) == 1


def test_stream_ingest_does_not_depend_on_the_trigger(spark):
    src = work_dir(spark, "art")
    for k in range(4):
        write_batch(spark, [(k, f"T{k}", f"/{k}", "May 6, 2031"), (10 + k, f"U{k}", f"/{10 + k}", f"May {7 + k}, 2031")], src, f"b{k}")
    schema = spark.createDataFrame([], ART).schema
    found = []
    for files in (None, 1):
        root = work_dir(spark, "idx")
        Si.start(spark, src, schema, root, work_dir(spark, "ck"), max_files_per_trigger=files).awaitTermination()
        found.append(sorted(map(str, Si.read_index_version(spark, root).collect())))
    assert found[0] == found[1] and len(found[0]) == 5


def test_the_model_step_gets_its_prompts_in_bounded_batches(spark):
    import sys

    from pressroll.session import configure

    def batch_bytes():
        return lambda prompt: str(sum(map(len, sys._getframe(1).f_locals["pdf"]["prompt"])))

    prompts = configure(spark).range(0, 60, 1, 1).select("id", F.repeat(F.lit("x"), 500_000).alias("prompt"))
    said = apply_model(prompts, "prompt", batch_bytes).select("id", F.col("response").cast("long").alias("n")).collect()
    assert sorted(r["id"] for r in said) == list(range(60)) and max(r["n"] for r in said) <= 5_000_000
