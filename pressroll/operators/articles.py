"""Article feed operators: parsed date, high-water mark, incremental filter,
grouping by date in first-seen order, article bodies, day text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroll.functions.dates import newer_than, parse_us_date
from pressroll.functions.strings import DAY_SEPARATOR, FETCH_FAILED_PREFIX, strip_html, truncate
from pressroll.operators.sequence import assemble_parts, position_in_group


def with_date(articles: DataFrame, raw_col: str = "publishedRaw") -> DataFrame:
    """Adds ``date`` parsed from the printed publication date (NULL if unparsable)."""
    return articles.withColumn("date", parse_us_date(F.col(raw_col)))


def high_water_mark(index: DataFrame) -> DataFrame:
    """One row, ``mark`` = latest saved date (NULL for an empty index)."""
    return index.agg(F.max("date").alias("mark"))


def newer_flags(articles: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``is_newer`` against the index's high-water mark.

    The mark is a scalar subquery: computed once, then a literal in every task.
    """
    mark = high_water_mark(index).scalar()
    return articles.withColumn("is_newer", newer_than(F.col("date"), mark))


def incremental(articles: DataFrame, index: DataFrame) -> DataFrame:
    """Parsed articles strictly newer than the saved mark; unparsable rows drop.

    A late article for an already saved date is dropped too (the mark is the
    late-data rule, not a watermark).
    """
    mark = high_water_mark(index).scalar()
    dated = with_date(articles)
    # the filter is pushed below the parse: each branch reads the parsed date
    # once, and only one branch runs per row
    d = F.col("date")
    keep = F.coalesce(F.when(mark.isNull() | (mark == F.lit("")), d.isNotNull()).otherwise(d > mark), F.lit(False))
    return dated.where(keep)


def group_by_date(dated: DataFrame, order: str = "ordinal") -> DataFrame:
    """Row-per-article grouping: ``first_ordinal`` orders the groups (first
    seen first) and ``pos`` is the article's place inside its date.
    """
    return position_in_group(dated, ["date"], [order], first_col="first_ordinal")


def article_bodies(feed: DataFrame, pages: DataFrame, budget: int | None = None) -> DataFrame:
    """Text per article: header, then the stripped body (cut to ``budget``
    characters where one is given), or a note when the page could not be
    fetched (no page with that link). Of pages stored twice under one url the
    latest (``page_id``, else the greatest text) counts.
    """
    latest = "page_id" if "page_id" in pages.columns else "html"
    # join first: only pages some article points at are stripped
    p = pages.where(F.col("url").isNotNull()).groupBy(F.col("url").alias("_url")).agg(F.max_by("html", latest).alias("_html"))
    j = feed.join(p, feed.url == p._url, "left")
    body = strip_html(F.col("_html"))
    body = body if budget is None else truncate(body, budget)
    header = F.concat(F.lit("URL: "), F.col("url"), F.lit("\n"), F.col("title"), F.lit("\n\n"))
    missing = F.concat(F.lit(FETCH_FAILED_PREFIX), F.lit("Failed to fetch "), F.col("url"), F.lit(" (404)]"))
    return j.select(*[c for c in feed.columns],
                    F.concat(header, F.when(F.col("_url").isNotNull(), body).otherwise(missing)).alias("text"))


def day_text(bodies: DataFrame, rows_per_part: int = 64) -> DataFrame:
    """Article texts of a date joined by the day separator, in list order, as
    consecutive parts of at most ``rows_per_part`` articles (parts joined by the
    same separator give the whole day text).
    """
    return assemble_parts(bodies, ["date"], ["ordinal"], "text", DAY_SEPARATOR, rows_per_part)
