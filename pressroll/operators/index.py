"""Summary index: derivation from the day store, upserts, archive queries.

The index is a table keyed by ``date`` (one row per day). Its order (newest
first on the site, oldest first in the ingest job) is a presentation choice
made by the writer, not a property of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroll.functions.strings import WS

INDEX_COLUMNS = ["date", "dateLabel", "headline", "storyCount", "moveCount", "tags"]


def tag_lists(stories: DataFrame, order: str) -> DataFrame:
    """(date, tags, n, first): one row per distinct tag list of a date, with how
    many stories carry it and the smallest story order among them. A hash
    aggregate with map-side combine; everything about tags is derived from it."""
    return (stories.groupBy("date", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
                   .agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")))


def first_seen_tags(lists: DataFrame) -> DataFrame:
    """(date, tag, first) from :func:`tag_lists`: ``first`` is the place (story
    order, position in the story's tag list) at which the tag is first seen."""
    exploded = lists.select("date", "first", F.posexplode("tags").alias("tag_pos", "tag"))
    return (exploded.groupBy("date", "tag")
                    .agg(F.min(F.struct(F.col("first").alias("order"), "tag_pos")).alias("first")))


def ordered_tags(tag_firsts: DataFrame) -> DataFrame:
    """(date, tags) with the distinct tags of a date in first-seen order (tags
    first seen at one place, which needs a repeated story order, by name)."""
    return (tag_firsts.groupBy("date")
                      .agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "tag"))),
                                       lambda x: x["tag"]).alias("tags")))


def index_entries(stories: DataFrame, moves: DataFrame, days: DataFrame, order: str = "ordinal") -> DataFrame:
    """One summary row per day: counts, label, headline, distinct tags in order."""
    lists = tag_lists(stories, order)
    story_counts = lists.groupBy("date").agg(F.sum("n").alias("storyCount"))
    move_counts = moves.groupBy("date").agg(F.count(F.lit(1)).alias("moveCount"))
    tags = ordered_tags(first_seen_tags(lists))
    return (days.select("date", "dateLabel", "headline")
                .join(story_counts, "date", "left")
                .join(move_counts, "date", "left")
                .join(tags, "date", "left")
                .select("date", "dateLabel", "headline",
                        F.coalesce("storyCount", F.lit(0)).cast("long").alias("storyCount"),
                        F.coalesce("moveCount", F.lit(0)).cast("long").alias("moveCount"),
                        F.coalesce("tags", F.array().cast("array<string>")).alias("tags")))


def flat_entries(grouped: DataFrame) -> DataFrame:
    """Index rows straight from dated articles (no model step): storyCount =
    articles of the date, moveCount = 0, tags = distinct titles first seen,
    headline = title of the first article.
    """
    tag_firsts = (grouped.groupBy("date", F.col("title").alias("tag"))
                         .agg(F.min("ordinal").alias("first")))
    per_date = grouped.groupBy("date").agg(
        F.count(F.lit(1)).cast("long").alias("storyCount"),
        F.min_by("title", "ordinal").alias("_head"))
    from pressroll.functions.dates import date_label
    return (per_date.join(ordered_tags(tag_firsts), "date")
                    .select("date", date_label(F.col("date")).alias("dateLabel"),
                            F.struct(F.col("_head").alias("ko"), F.col("_head").alias("en")).alias("headline"),
                            "storyCount", F.lit(0).cast("long").alias("moveCount"), "tags"))


# --- upserts ------------------------------------------------------------------

def one_per_key(rows: DataFrame, key: str = "date") -> DataFrame:
    """One row per key: of rows that repeat a key the greatest, column by column."""
    kept = rows.groupBy(key).agg(F.max(F.struct(*rows.columns)).alias("_row"))
    return kept.select("_row.*")


def upsert(index: DataFrame, new: DataFrame, key: str = "date") -> DataFrame:
    """Replace rows with the same key, add the others (``new`` once per key)."""
    return index.join(new.select(key), key, "left_anti").unionByName(one_per_key(new, key))


def insert_absent(index: DataFrame, new: DataFrame, key: str = "date") -> DataFrame:
    """Add only rows whose key is not in the index yet (``new`` once per key)."""
    return index.unionByName(one_per_key(new, key).join(index.select(key), key, "left_anti"))


def replace_existing(index: DataFrame, new: DataFrame, key: str = "date"):
    """(result, missing): replace rows that exist; updates without a row are
    returned apart instead of being written (they are an error)."""
    keys = index.select(key)
    hits = new.join(keys, key, "left_semi")
    missing = new.join(keys, key, "left_anti")
    return upsert(index, hits, key), missing


def row_hash(cols: Sequence[Column]) -> Column:
    """Version token of a row's content (SHA-256 of its fields as JSON, so
    neighbouring fields, lists and NULLs cannot be mistaken for each other)."""
    fields = [c.alias(f"f{i}") for i, c in enumerate(cols)]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def versioned_upsert(index: DataFrame, updates: DataFrame, cols: Sequence[Column],
                     key: str = "date", base_col: str = "base_sha", priority: Sequence[Column] = ()):
    """Compare-and-set: an update carries the token of the row it was made from.

    Returns (result, accepted, rejected). New keys need a NULL/empty token;
    an existing key needs the token of its current row. Of several updates of
    one key that hold a valid token only the first by ``priority`` (then by
    content) wins, as the write of the first makes the token stale.
    """
    current = index.select(key, row_hash(cols).alias("_cur"))
    j = updates.join(current, key, "left")
    base = F.col(base_col)
    ok = F.when(F.col("_cur").isNull(), base.isNull() | (base == "")).otherwise(F.coalesce(base == F.col("_cur"), F.lit(False)))
    place = F.row_number().over(Window.partitionBy(key, "_ok").orderBy(*priority, F.to_json(F.struct(*updates.columns))))
    judged = j.withColumn("_ok", ok).withColumn("_ok", F.col("_ok") & (place == 1)).drop("_cur")
    accepted = judged.where("_ok").drop("_ok")
    rejected = judged.where("not _ok").drop("_ok")
    return upsert(index, accepted.drop(base_col), key), accepted, rejected


# --- archive queries ---------------------------------------------------------

def by_tags(archive: DataFrame, tags: Sequence[str], mode: str = "any") -> DataFrame:
    """Entries carrying any (default) or all of the selected tags."""
    sel = F.array(*[F.lit(t) for t in tags])
    if mode == "all":
        return archive.where(F.size(F.array_except(sel, F.col("tags"))) == 0)
    return archive.where(F.arrays_overlap(F.col("tags"), sel))


def stories_by_tag(stories: DataFrame, tag: str, mode: str = "exact") -> DataFrame:
    """Stories with a tag (``__all__`` keeps all); ``mode="substring"`` matches the
    tag inside the comma-joined tag list, as a browser data attribute does."""
    if tag == "__all__":
        return stories
    if mode == "substring":
        return stories.where(F.contains(F.array_join("tags", ","), F.lit(tag)))
    return stories.where(F.array_contains("tags", tag))


def search(archive: DataFrame, keyword: str, fields: Sequence[str] = ("headline",)) -> DataFrame:
    """Case-insensitive substring search over headline text and tags; blank
    keyword keeps everything."""
    if not keyword.strip():
        return archive
    hay = F.lower(F.concat_ws(" ", *[F.col(f) for f in fields], F.array_join("tags", " ")))
    return archive.where(F.contains(hay, F.lit(keyword.lower())))


def day_lookup(table: DataFrame, date: str) -> DataFrame:
    """Rows of one date (a partition filter on a date-partitioned table)."""
    return table.where(F.col("date") == F.lit(date))


def tag_vocabulary(stories_or_index: DataFrame) -> DataFrame:
    """Distinct tags with how many rows carry them."""
    return (stories_or_index.select(F.explode("tags").alias("tag"))
                            .groupBy("tag").agg(F.count(F.lit(1)).alias("n")))


def by_month(index: DataFrame) -> DataFrame:
    """Archive folded by month: entries and stories per ``YYYY-MM``."""
    return (index.groupBy(F.substring("date", 1, 7).alias("month"))
                 .agg(F.count(F.lit(1)).alias("n_days"),
                      F.sum("storyCount").cast("long").alias("n_stories"),
                      F.min("date").alias("first_date"),
                      F.max("date").alias("last_date")))


def linked(stories: DataFrame) -> DataFrame:
    """Stories that link to a source: url set and not blank."""
    return stories.where(F.col("url").isNotNull() & F.col("url").rlike(r"[^" + WS + r"]"))
