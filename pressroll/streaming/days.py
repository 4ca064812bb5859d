"""The whole ingest as a stream: articles arrive, dates are closed, organised,
stored and indexed.

Two queries, each with a checkpoint of its own:

``start_arrivals`` reads article files. A batch's articles newer than the mark
are written to ``staged/epoch=E/date=D``, then how many came for each date to
``arrivals/epoch=E`` (one small file, so a batch is seen as a whole or not at all).

``start_closing`` reads the arrivals. A state per date counts its articles and
keeps the last epoch that had some, nothing else, so a date of any size is a
row of state; a timer closes the date when the watermark (the latest date seen
less ``lateness``) passes it. A batch's closed dates are read from the staged
partitions, and from no others, go through the ingest job (model answers are
kept by prompt, so a replay calls nothing) into the day store, and their index
entries are committed as a version of the index that rewrites the months
concerned. Its work is that of the dates it closes.

What is replayed after a failure writes the same folders, the same days and the
same index rows again. The mark is that of the index version the arrivals
started from. An article that comes after its date was closed is ignored, as
the job ignores articles for a stored date; a state row says that it was closed.
Where a feed ends, :func:`close_feed` lets the watermark pass all dates.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from pressroll.operators import articles as A
from pressroll.operators.model import ModelFactory
from pressroll.plans.ingest import STORY, ingest
from pressroll.sources import files as Fs
from pressroll.sources.commits import VersionedTable

ARRIVALS = "date string, n long, epoch long"
CLOSED = "date string, n_articles long, last_epoch long"
LAST_DATE = "9999-12-31"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Folders:
    """Where a feed's stream keeps its tables."""

    root: str

    def __getattr__(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


def index_table(spark: SparkSession, folders: Folders) -> VersionedTable:
    return VersionedTable(spark, folders.index)


def seed_index(index: DataFrame, folders: Folders) -> None:
    """Version 1 of the index: what was saved before the stream."""
    table = index_table(index.sparkSession, folders)
    table.create(Fs.INDEX_SCHEMA)
    table.run(lambda t: t.upsert(index), what="seed")


def _reader(spark: SparkSession, schema, max_files: int | None):
    reader = spark.readStream.schema(schema)
    return reader.option("maxFilesPerTrigger", max_files) if max_files else reader


def start_arrivals(articles: DataFrame, folders: Folders, base: int | None = None) -> StreamingQuery:
    """Stage the streaming ``articles`` by date. ``base`` is the index version
    whose mark holds for the run (default: the newest); pass it again to go on
    with a run that was broken off."""
    spark = articles.sparkSession
    table = index_table(spark, folders)
    version = table.log.latest() if base is None else base

    def stage(batch: DataFrame, epoch: int) -> None:
        if Fs.folder_exists(batch.sparkSession, f"{folders.arrivals}/epoch={epoch}/_SUCCESS"):
            return  # a replay of what was seen already
        staged = f"{folders.staged}/epoch={epoch}"
        fresh = A.incremental(batch, table.rows(version))
        Fs.write_days(fresh, staged)
        came = batch.sparkSession.read.schema(fresh.schema).parquet(staged)
        came.groupBy("date").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{folders.arrivals}/epoch={epoch}")

    writer = articles.writeStream.foreachBatch(stage).option("checkpointLocation", folders.arrivals_checkpoint)
    return writer.trigger(availableNow=True).start()


def close_feed(spark: SparkSession, folders: Folders) -> None:
    """An arrival of nothing on the last date there is: all others get closed."""
    end = spark.createDataFrame([(LAST_DATE, 0)], "date string, n long")
    end.coalesce(1).write.mode("overwrite").parquet(f"{folders.arrivals}/epoch={1 << 40}")


class Dates(StatefulProcessor):
    """Per date: the articles awaited, the last epoch that had some, whether it is closed."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("date", "n long, last_epoch long, closed boolean")

    def handleInputRows(self, key, rows, timerValues):
        n, last, closed = self.state.get() if self.state.exists() else (0, -1, False)
        if closed:
            return
        for r in rows:
            n, last = n + r["n"], max(last, r["epoch"])
        self.state.update((n, last, False))
        at = int(datetime.fromisoformat(key[0]).replace(tzinfo=timezone.utc).timestamp() * 1000)
        if at not in self.handle.listTimers():
            self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        n, last, closed = self.state.get()
        if not closed:
            self.state.update((n, last, True))
            yield Row(date=key[0], n_articles=n, last_epoch=last)

    def close(self) -> None:
        pass


def closed_dates(arrivals: DataFrame, lateness: str) -> DataFrame:
    """Dates the watermark has passed, each once (append mode)."""
    timed = arrivals.withColumn("ts", F.to_timestamp("date")).withWatermark("ts", lateness)
    return timed.groupBy("date").transformWithState(Dates(), CLOSED, "Append", "EventTime")


def start_closing(spark: SparkSession, pages: DataFrame, folders: Folders, model_factory: ModelFactory, staged_schema,
                  lateness: str = "2 days", max_files: int | None = None, rows_per_part: int = 64) -> StreamingQuery:
    """Close dates, organise and store them, commit their index entries."""
    arrivals = _reader(spark, ARRIVALS, max_files).parquet(folders.arrivals)

    def store(batch: DataFrame, epoch: int) -> None:
        closed = batch.where(F.col("n_articles") > 0)
        dates = closed.collect()  # a row per calendar date that ends in this batch
        if not dates:
            return
        s = batch.sparkSession
        rows = (s.read.schema(f"{staged_schema}, epoch long").option("basePath", folders.staged).parquet(folders.staged)
                 .where(F.col("date").isin([r["date"] for r in dates])))
        wanted = s.createDataFrame(dates, CLOSED)
        rows = rows.join(wanted.select("date", "last_epoch"), "date").where("epoch <= last_epoch").drop("epoch", "last_epoch")
        nothing = s.createDataFrame([], Fs.INDEX_SCHEMA)
        result = ingest(rows, pages, nothing, model_factory, rows_per_part=rows_per_part, store=folders.store, answers=folders.answers)
        result.report.write.mode("overwrite").parquet(f"{folders.report}/epoch={epoch}")
        result.errors.write.mode("overwrite").parquet(f"{folders.errors}/epoch={epoch}")
        index_table(s, folders).run(lambda t: t.upsert(result.index), what="close", epoch=epoch)

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # timers and typed state need it
    try:
        writer = closed_dates(arrivals, lateness).writeStream.foreachBatch(store).outputMode("append")
        return writer.option("checkpointLocation", folders.closing_checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def stored_stories(spark: SparkSession, folders: Folders) -> DataFrame:
    """The stories of the day store (none where no day was stored)."""
    if not Fs.folder_exists(spark, f"{folders.store}/stories"):
        return spark.createDataFrame([], f"ordinal long, r {STORY}, date string").select("ordinal", "r.*", "date")
    return spark.read.parquet(f"{folders.store}/stories")
