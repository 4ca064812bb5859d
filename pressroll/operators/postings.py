"""Substring search by postings of trigrams.

A keyword of three or more characters occurs only in entries that hold each of
its trigrams. The postings say which entries hold a trigram, the counts how
many; a search reads the counts of the keyword's own trigrams, meets the
postings of the rarest ones, and looks at the text of what is left. A keyword
of one or two characters is looked up in the texts themselves.

Layout, both parts dealt by a hash of the trigram so that a search opens the
folders of its own trigrams only, sorted so that it reads few row groups there:

    postings/bucket=B    gram, id
    counts/bucket=B      gram, n

A trigram found in all entries is many rows, never one list.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
#: Trigrams of a keyword whose postings are met (the rarest ones).
RAREST = 4


def haystack(fields: Sequence[str] = ("headline",), tags: str = "tags") -> Column:
    """The text a search looks at: headline fields and tags, lower-cased."""
    return F.lower(F.concat_ws(" ", *[F.col(f) for f in fields], F.array_join(tags, " ")))


def grams_of(keyword: str) -> list[str]:
    return list(dict.fromkeys(keyword[i : i + GRAM] for i in range(len(keyword) - GRAM + 1)))


def build(entries: DataFrame, hay: Column, root: str, id_col: str = "doc_id", buckets: int = 64) -> Postings:
    """Write the postings of ``hay`` under ``root`` (a null text has none)."""
    # One pass over the text: a look-ahead matches at every character.
    windows = F.array_distinct(F.regexp_extract_all(hay, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))
    rows = entries.select(F.col(id_col).alias("id"), F.explode(windows).alias("gram"))
    placed = rows.withColumn("bucket", _bucket(F.col("gram"), buckets))
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A frequent trigram spreads over several tasks, since ids are part of the range.
    (placed.repartitionByRange(n, "bucket", "gram", "id").sortWithinPartitions("bucket", "gram", "id")
           .write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/postings"))
    found = Postings(entries.sparkSession, root, buckets)
    counts = found.postings().groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("n"))
    (counts.repartitionByRange(n, "bucket", "gram").sortWithinPartitions("bucket", "gram")
           .write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/counts"))
    return found


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


class Postings:
    """Postings written by :func:`build`."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root, buckets

    def postings(self) -> DataFrame:
        return self._read("postings")

    def _read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{name}")
        return df.withColumn("bucket", F.col("bucket").cast("int"))

    def _asked(self, name: str, grams: Sequence[str]) -> DataFrame:
        """Rows of the grams; only their buckets' folders are opened."""
        literal = [F.lit(g) for g in grams]
        buckets = self.spark.range(1).select(F.array(*[_bucket(g, self.buckets) for g in literal])).first()[0]
        df = self.spark.read.parquet(f"{self.root}/{name}")
        return df.where(F.col("bucket").isin([str(b) for b in set(buckets)]) & F.col("gram").isin(list(grams)))

    def candidates(self, keyword: str) -> DataFrame | None:
        """Ids of the entries that hold the keyword's rarest trigrams; None if
        the keyword has no trigram."""
        grams = grams_of(keyword.lower())
        if not grams:
            return None
        counts = {r["gram"]: r["n"] for r in self._asked("counts", grams).collect()}  # a row per trigram of the keyword
        if len(counts) < len(grams):
            return self.postings().where("false").select("id")
        rarest = sorted(grams, key=lambda g: (counts[g], g))[:RAREST]
        rows = self._asked("postings", rarest)
        return rows.groupBy("id").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") == len(rarest)).select("id")

    def search(self, entries: DataFrame, hay: Column, keyword: str, id_col: str = "doc_id") -> DataFrame:
        """Entries whose text contains the keyword, any case; a blank keyword keeps all."""
        if not keyword.strip():
            return entries
        ids = self.candidates(keyword)
        near = entries if ids is None else entries.join(ids.withColumnRenamed("id", "_id"), F.col(id_col) == F.col("_id"), "left_semi")
        return near.where(F.contains(hay, F.lit(keyword.lower())))

    def search_each(self, entries: DataFrame, hay: Column, keywords: Sequence[str], id_col: str = "doc_id") -> DataFrame:
        """(keyword, entry) of several searches."""
        return reduce(DataFrame.unionByName, [self.search(entries, hay, k, id_col).select(F.lit(k).alias("keyword"), "*") for k in keywords])
