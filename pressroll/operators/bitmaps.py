"""Tag selections over bitmaps.

A tag's entries are bitmaps of 32,768 ids each, one row per tag and block of ids.
Any number of selections is answered in one pass: the selections are joined with
the tags they name, and the bitmaps of a block are or-ed (``any``) or and-ed
(``all``). The work is that of the bitmaps named, not of the entries; a tag that
all entries carry is as many rows as any other.

Ids are integers; dense ones make small bitmaps, sparse ones more rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 32_768


def tag_bitmaps(entries: DataFrame, id_col: str = "doc_id", tags_col: str = "tags") -> DataFrame:
    """(tag, block, bits): which ids of a block carry the tag (null ids and tags are left out)."""
    rows = entries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.explode(tags_col).alias("tag"))
    rows = rows.where(F.col("tag").isNotNull())
    return (rows.groupBy("tag", F.bitmap_bucket_number("id").alias("block"))
                .agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits")))


def select_each(bitmaps: DataFrame, selections: DataFrame) -> DataFrame:
    """(selection, block, bits) of all selections: rows of ``selections`` have a
    ``selection``, its ``tags`` and its ``mode``, any or all. A selection without
    tags selects nothing."""
    named = selections.select("selection", "mode", F.array_distinct("tags").alias("tags"))
    named = named.select("selection", "mode", F.size("tags").alias("n_tags"), F.explode("tags").alias("tag"))
    both = named.join(bitmaps, "tag").groupBy("selection", "mode", "n_tags", "block").agg(
        F.bitmap_or_agg("bits").alias("one"), F.bitmap_and_agg("bits").alias("each"), F.count(F.lit(1)).alias("n"))
    found = F.when(F.col("mode") == "any", F.col("one")).when(F.col("n") == F.col("n_tags"), F.col("each"))
    return both.select("selection", "block", found.alias("bits")).where(F.bitmap_count("bits") > 0)


def counts(selected: DataFrame) -> DataFrame:
    """(selection, n): how many ids, counted on the bitmaps."""
    return selected.groupBy("selection").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def ids(selected: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(selection, id) of what is selected."""
    def byte(i: Column) -> Column:
        return F.conv(F.hex(F.substring("bits", i, F.lit(1))), 16, 10).cast("int")

    # Bytes with a bit first, then their bits: the empty ones cost nothing more.
    filled = F.filter(F.transform(F.sequence(F.lit(1), F.lit(BLOCK // 8)), lambda i: F.struct(i.alias("at"), byte(i).alias("byte"))),
                      lambda x: x["byte"] != 0)
    rows = selected.select("selection", "block", F.explode(filled).alias("x"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.col("x.byte").bitwiseAND(F.pow(F.lit(2), b).cast("int")) != 0)
    rows = rows.select("selection", "block", ((F.col("x.at") - 1) * 8).alias("at"), F.explode(bits).alias("bit"))
    at = F.col("at") + F.col("bit")
    number = F.when(F.col("block") > 0, (F.col("block") - 1) * BLOCK + at + 1).otherwise(F.col("block") * BLOCK - at)
    return rows.select("selection", number.cast("long").alias(id_col))
