"""The ingest job: new articles -> organised, validated day documents ->
day store -> index upsert -> run report.

    feed - parse date - newer than the index mark -+
    pages - strip ---------------------- left join +- day text parts - prompt
      - model (written once) - fenced JSON - parts of a date merged into one day
      - day rules on the merged day - error rows | valid days
      - day store (stories, injuries, moves, schedule, days) - index upsert
      + all dates - report (added | error, number of errors, checked articles)

A date's articles are organised in parts of at most ``rows_per_part`` articles,
one model call each, since a date may be too large for one call. The parts are
merged again before anything is judged: elements are numbered through the whole
day, its lists may be empty in some parts, and its headline is the first valid
one. The result therefore does not depend on the part size (as far as the model
answers for an article alone).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroll.functions import documents as V
from pressroll.functions.dates import date_label_plain
from pressroll.functions.strings import organize_prompt, parse_fenced_json
from pressroll.operators import articles as A
from pressroll.operators import index as I
from pressroll.operators.integrity import truthy
from pressroll.operators.model import ModelFactory, answered, apply_model
from pressroll.session import materialize, where_computed
from pressroll.sources import files as Fs

LISTS = ("stories", "injuries", "moves", "schedule")
NOT_A_LIST = {"stories": V.MSG_DAY_STORIES, "injuries": V.MSG_DAY_INJURIES, "moves": V.MSG_DAY_MOVES,
              "schedule": V.MSG_DAY_SCHEDULE}
BI = "struct<ko:string,en:string>"
BILIST = "struct<ko:array<string>,en:array<string>>"
STORY = f"struct<icon:string,status:string,tags:array<string>,title:{BI},facts:{BILIST},interp:{BI},url:string>"
ROWS = {"injuries": f"struct<player:{BI},issue:{BI},status:{BI},watch:boolean>",
        "moves": f"struct<date:string,text:{BI}>", "schedule": f"struct<date:{BI},text:{BI}>"}


@dataclass
class IngestResult:
    index: DataFrame      # upserted index
    stories: DataFrame    # story rows of the added days
    rows: dict[str, DataFrame]  # their injuries, moves and schedule rows
    days: DataFrame       # their headers
    report: DataFrame     # one row per new date
    errors: DataFrame     # every error of a day that was not added: date, place, message
    responses: DataFrame  # stored model output


def _items(v: V.J) -> Column:
    """``x || []`` as an array; NULL where x is something else than a list."""
    empty = F.array().cast("array<variant>")
    return F.when(~truthy(v), empty).otherwise(F.try_variant_get(v.base, v.path, "array<variant>"))


def _merged(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The answers as (one row per part, one row per list element), each
    written once; the elements carry their place in the merged day."""
    parsed = where_computed(responses, {"p": parse_fenced_json(F.col("response"))}, lambda s: F.lit(True))
    o = V.J(F.col("p.value"))
    error = F.coalesce("model_error", "p.error")
    parts = materialize(parsed.select(
        "date", "part", error.alias("step_error"),
        F.when(V.is_bilingual(o["headline"]), F.try_variant_get("p.value", "$.headline", BI)).alias("headline"),
        *[F.coalesce(F.size(_items(o[k])), F.lit(-1)).alias(k) for k in LISTS]), "parts")
    listed = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(_items(o[k]), F.array().cast("array<variant>")).alias("items"))
                       for k in LISTS])
    found = (parsed.where(error.isNull()).select("date", "part", F.explode(listed).alias("l"))
                   .select("date", "part", "l.kind", F.posexplode("l.items").alias("at", "item"))
                   .select("date", "part", "kind", "at", F.to_json("item").alias("item")))
    before = Window.partitionBy("date").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.select("date", "part", *[F.coalesce(F.sum(F.greatest(F.col(k), F.lit(0))).over(before), F.lit(0)).alias(k) for k in LISTS])
    starts = sums.select("date", "part", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(k).alias("start")) for k in LISTS])).alias("s")).select("date", "part", "s.*")
    elements = materialize(found.join(starts, ["date", "part", "kind"]).select(
        "date", "kind", (F.col("start") + F.col("at")).cast("long").alias("pos"), "item"), "elements")
    return parts, elements


def _errors(parts: DataFrame, elements: DataFrame) -> DataFrame:
    """(date, place, message) of everything wrong with the merged days."""
    step = parts.where("step_error is not null").select("date", F.format_string("part %06d", "part").alias("place"),
                                                        F.col("step_error").alias("message"))
    lists = F.array_compact(F.array(*[F.when(F.col(k) < 0, F.lit(NOT_A_LIST[k])) for k in LISTS]))
    shapes = parts.where("step_error is null").select("date", F.lit("day").alias("place"), F.explode(lists).alias("message")).distinct()
    whole = parts.groupBy("date").agg(F.count("step_error").alias("failed"), F.count("headline").alias("headlines"),
                                      F.sum(F.greatest("stories", F.lit(0))).alias("stories"), F.min("stories").alias("least"))
    day = F.array_compact(F.array(F.when(F.col("headlines") == 0, F.lit(V.MSG_DAY_HEADLINE)),
                                  F.when((F.col("stories") == 0) & (F.col("least") >= 0), F.lit(V.MSG_DAY_STORIES))))
    days = whole.where("failed = 0").select("date", F.lit("day").alias("place"), F.explode(day).alias("message"))
    item = F.try_parse_json("item")
    rule = F.when(F.col("kind") == "stories", V.story_errors(F.col("v")))
    for kind in LISTS[1:]:
        rule = rule.when(F.col("kind") == kind, V.ROW_RULES[kind](F.col("v")))
    place = F.concat("kind", F.lit("["), F.col("pos").cast("string"), F.lit("]"))
    single = elements.select("date", "kind", "pos", item.alias("v")).select(
        "date", place.alias("place"), F.explode(rule).alias("m")).select("date", "place", F.concat("place", F.lit(": "), "m").alias("message"))
    return materialize(step.unionByName(shapes).unionByName(days).unionByName(single), "errors")


def ingest(feed: DataFrame, pages: DataFrame, index: DataFrame, model_factory: ModelFactory,
           rows_per_part: int = 64, model_tasks: int | None = None, store: str | None = None,
           answers: str | None = None) -> IngestResult:
    """Run the job. ``model_tasks`` is the number of tasks that call the model
    (default: the shuffle partitions); with ``store`` the days are written there
    by date, before the index is derived from what was written; with ``answers``
    the model's answers are kept there by prompt, and a prompt answered before
    is not called again."""
    spark = feed.sparkSession
    fresh = A.incremental(feed.drop("date"), index)
    checked = fresh.agg(F.count(F.lit(1)).alias("n")).scalar()
    parts = A.day_text(A.article_bodies(fresh, pages), rows_per_part)
    prompts = parts.select("date", "part", organize_prompt(F.col("date"), F.col("text")).alias("prompt"))
    # calls cost the same whatever the prompt's size: spread them by number, not by bytes
    tasks = model_tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if answers is None:
        said = apply_model(prompts.repartition(tasks, "date", "part"), "prompt", model_factory)
    else:
        said = answered(prompts, "prompt", model_factory, answers, tasks=tasks).drop("attempt")
    # the model runs once per prompt: its output is written before any use
    responses = materialize(said.drop("prompt"), "model-out")

    merged, elements = _merged(responses)
    errors = _errors(merged, elements)
    heads = merged.groupBy("date").agg(F.min_by("headline", F.when(F.col("headline").isNotNull(), F.col("part"))).alias("headline"))
    counts = errors.groupBy("date").agg(F.count(F.lit(1)).alias("n_errors"))
    per_date = heads.join(counts, "date", "left").withColumn("n_errors", F.coalesce("n_errors", F.lit(0)).cast("long"))
    report = per_date.select(
        "date", F.when(F.col("n_errors") == 0, F.lit("added")).otherwise(F.lit("error")).alias("outcome"),
        "n_errors", checked.cast("long").alias("checked_articles"))

    added = per_date.where("n_errors = 0")
    kept = elements.join(added.select("date"), "date", "left_semi")

    def typed(kind: str, ddl: str) -> DataFrame:
        row = F.try_variant_get(F.parse_json("item"), "$", ddl)
        return kept.where(F.col("kind") == kind).select("date", F.col("pos").alias("ordinal"), row.alias("r")).select("date", "ordinal", "r.*")

    stories = typed("stories", STORY)
    rows = {kind: typed(kind, ddl) if kind == "injuries" else _dated(kept, kind, ddl) for kind, ddl in ROWS.items()}
    days = added.select("date", date_label_plain(F.col("date")).alias("dateLabel"), "headline")
    if store is not None:
        written = {"stories": stories, "days": days, **rows}
        for name, df in written.items():
            Fs.write_days(df, f"{store}/{name}")
        back = {name: _read(spark, f"{store}/{name}", df) for name, df in written.items()}
        stories, days, rows = back["stories"], back["days"], {k: back[k] for k in rows}
    entries = I.index_entries(stories, rows["moves"], days)
    return IngestResult(index=I.upsert(index, entries), stories=stories, rows=rows, days=days, report=report,
                        errors=errors, responses=responses)


def _dated(kept: DataFrame, kind: str, ddl: str) -> DataFrame:
    """Rows that have a ``date`` of their own, which is called ``row_date``."""
    row = F.try_variant_get(F.parse_json("item"), "$", ddl)
    return kept.where(F.col("kind") == kind).select("date", F.col("pos").alias("ordinal"), row.alias("r")).select(
        "date", "ordinal", F.col("r.date").alias("row_date"), F.col("r.text").alias("text"))


def _read(spark, path: str, written: DataFrame) -> DataFrame:
    """What was written, with its schema even where there was nothing to write."""
    return spark.read.schema(written.schema).parquet(path).select(*written.columns)
