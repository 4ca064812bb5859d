"""Index entries, month and tag summaries kept up to date from changed dates.

Four versioned tables under one root:

    entries     an index entry per date                    part: month
    date_tags   (date, tag): stories of a date with a tag  part: month
    months      the archive folded by month                part: year
    tags        how many stories carry a tag               part: first character

A change names dates and holds their new stories, moves and headers (none: the
date is gone). The dates' new entries and tag counts are derived from these
alone; what the tables said about them before is retracted, what is new is
added. Tags change by the difference; a month is folded again from its at most
31 entries, since a first or last date cannot be subtracted. The work follows
the changed dates, whatever the archive holds; the tables equal a derivation
from the whole store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressroll.operators import index as I
from pressroll.session import materialize
from pressroll.sources.commits import VersionedTable
from pressroll.sources.files import INDEX_SCHEMA

MONTH = "substring(date, 1, 7)"


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TEXT, _LONG = T.StringType(), T.LongType()


class Summaries:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.entries = VersionedTable(spark, f"{root}/entries", "date", MONTH)
        self.date_tags = VersionedTable(spark, f"{root}/date_tags", "date_tag", MONTH)
        self.months = VersionedTable(spark, f"{root}/months", "month", "substring(month, 1, 4)")
        self.tags = VersionedTable(spark, f"{root}/tags", "tag", "substring(tag, 1, 1)")

    def create(self) -> None:
        self.entries.create(INDEX_SCHEMA)
        self.date_tags.create(_schema(date_tag=_TEXT, date=_TEXT, tag=_TEXT, n=_LONG))
        self.months.create(_schema(month=_TEXT, n_days=_LONG, n_stories=_LONG, first_date=_TEXT, last_date=_TEXT))
        self.tags.create(_schema(tag=_TEXT, n=_LONG))

    def apply(self, dates: DataFrame, stories: DataFrame, moves: DataFrame, days: DataFrame, order: str = "ordinal") -> None:
        """Replace what is stored about ``dates`` (column ``date``) by what the
        rows say, which must be all rows of these dates and of no others."""
        dates = materialize(dates.select("date").distinct(), "changed")
        entries = materialize(I.index_entries(stories, moves, days, order), "new-entries")
        counted = (stories.select("date", F.explode("tags").alias("tag")).groupBy("date", "tag").agg(F.count(F.lit(1)).alias("n")))
        counted = materialize(counted.select(F.to_json(F.array("date", "tag")).alias("date_tag"), "date", "tag", "n"), "new-tags")

        change = self.entries.begin()
        gone = dates.join(entries.select("date"), "date", "left_anti")
        change.delete(gone)
        change.upsert(entries)
        change.commit()

        old = self.date_tags.begin()
        before = materialize(old.read_for(dates).join(dates, "date", "left_semi"), "old-tags")
        old.delete(before.join(counted.select("date_tag"), "date_tag", "left_anti"))
        old.upsert(counted)
        old.commit()
        difference = (counted.select("tag", "n").unionByName(before.select("tag", (-F.col("n")).alias("n")))
                             .groupBy("tag").agg(F.sum("n").alias("n")).where("n <> 0"))
        self._add_tags(materialize(difference, "tag-change"))
        self._fold_months(dates)

    def _add_tags(self, difference: DataFrame) -> None:
        def change(transaction) -> None:
            old = transaction.read_for(difference).join(difference.select("tag"), "tag", "left_semi")
            new = old.unionByName(difference).groupBy("tag").agg(F.sum("n").alias("n"))
            transaction.delete(new.where("n = 0"))
            transaction.upsert(new.where("n <> 0"))

        self.tags.run(change)

    def _fold_months(self, dates: DataFrame) -> None:
        months = materialize(dates.select(F.expr(MONTH).alias("month")).distinct(), "changed-months")
        rows = self.entries.rows(parts=self.entries.parts_of(dates))

        def change(transaction) -> None:
            new = I.by_month(rows)
            transaction.delete(months.join(new.select("month"), "month", "left_anti"))
            transaction.upsert(new)

        self.months.run(change)
