"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item of n distinct shingles (five lower-cased words in a row; an item of
k < 5 words is one shingle of k) lies in a document if the document holds 75 %
of them, anywhere. Items are partitioned by the power of two of their size; the
MinHash sketch of an item is its ``bottom`` smallest shingle hashes, more for
larger items: floor(n/4) + 1. A document lacks fewer than that many of the
item's shingles if it contains it, so a containing document shares at least one
sketch hash with the item: the search misses nothing. Each partition has a bound
of its own, its largest sketch hash, and is searched on its own: a document's
hash is looked up in the partitions whose bound it meets. The larger the items,
the fewer of a document's hashes that is. Candidates are then verified on the
exact shingles.

DataFrame expressions only. The sketches join by equality, so Spark broadcasts
them only while their measured size allows it.

Edge cases: null or empty texts (on either side) match nothing; rows that
repeat an id (or have none) are one document or item whose texts are pooled;
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroll.llm.common import identified, materialize

SHINGLE_WORDS = 5
PERCENT = 75
BLANKS = " \t\n\x0b\f\r"


def _words(text: Column) -> Column:
    trimmed = F.btrim(F.lower(text), F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def _split(texts: DataFrame) -> DataFrame:
    split = texts.select("id", _words(F.col("text")).alias("words"))
    return split.where(F.size("words") > 0).withColumn("k", F.least(F.size("words"), F.lit(SHINGLE_WORDS)))


def _hash(k: int) -> Column:
    return F.xxhash64(*[F.get("words", F.col("at") + i) for i in range(k)])


def _placed(split: DataFrame, k: Column) -> DataFrame:
    """One row per shingle of k words of the texts that have so many: id, words, k, place."""
    long = split.where(F.size("words") >= k)
    return long.select("id", "words", k.alias("k"), F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("at"))


def _item_shingles(items: DataFrame) -> DataFrame:
    hashed = F.when(F.col("k") == SHINGLE_WORDS, _hash(SHINGLE_WORDS))
    for k in range(1, SHINGLE_WORDS):
        hashed = hashed.when(F.col("k") == k, _hash(k))
    return _placed(_split(items), F.col("k")).withColumn("hash", hashed)


def _exact(placed: DataFrame) -> DataFrame:
    text = F.array_join(F.slice("words", F.col("at") + 1, F.col("k")), " ")
    return placed.select("id", text.alias("shingle"))


def _sketches(items: DataFrame) -> DataFrame:
    hashes = _item_shingles(items).groupBy("id").agg(F.sort_array(F.collect_set(F.struct("hash", "k"))).alias("hashes"))
    n = F.size("hashes")
    return hashes.select(F.floor(F.log2(n)).cast("int").alias("part"), F.col("id").alias("item"),
                         F.explode(F.slice("hashes", 1, F.floor(n / 4).cast("int") + 1)).alias("s")).select("part", "item", "s.hash", "s.k")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def find_contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document and item it contains: ids, ``n_shared``, ``n_item``."""
    if percent < 75:
        raise ValueError("the sketches are sized for a containment of 75 % or more")
    docs = identified(docs, id_col, text_col).toDF("id", "text")
    items = identified(items, item_col, item_text_col).toDF("id", "text")
    sketches = materialize(_sketches(items), "sketches")
    # A bound per size partition and shingle length: at most 31 rows and four for short items.
    bounds: dict[int, list[tuple[int, int]]] = {}
    for r in sketches.groupBy("k", "part").agg(F.max("hash").alias("bound")).collect():
        bounds.setdefault(r["k"], []).append((r["part"], r["bound"]))
    split = _split(docs).drop("k")
    lengths = sorted(bounds) or [SHINGLE_WORDS]

    def looked_up(k: int) -> DataFrame:
        hashed = _placed(split, F.lit(k)).select("id", _hash(k).alias("hash"))
        parts = F.array_compact(F.array(*[F.when(F.col("hash") <= F.lit(bound), F.lit(part)) for part, bound in bounds.get(k, [])]))
        low = hashed.where(F.col("hash") <= F.lit(max((b for _, b in bounds.get(k, [])), default=None)))
        return low.select("id", "hash", F.explode(parts.cast("array<int>")).alias("part"))

    met = _union([looked_up(k) for k in lengths]).join(sketches.select("part", "item", "hash"), ["part", "hash"])
    candidates = materialize(met.select("id", "item").distinct(), "candidates")

    wanted = candidates.select(F.col("id").alias("found")).distinct()
    texts = docs.join(wanted, docs["id"].eqNullSafe(wanted["found"]), "left_semi")
    own = _exact(_item_shingles(items)).distinct().withColumnsRenamed({"id": "own", "shingle": "text"})
    sizes = own.groupBy("own").agg(F.count("*").alias("n_item"))
    chosen = _split(texts).drop("k")
    of_docs = _union([_exact(_placed(chosen, F.lit(k))) for k in lengths]).distinct()
    shared = (of_docs.join(own, of_docs["shingle"] == own["text"]).groupBy("id", "own").agg(F.count("*").alias("n_shared")))
    sized = shared.join(sizes.withColumnRenamed("own", "sized"), F.col("own").eqNullSafe(F.col("sized")))
    named = candidates.toDF("c_id", "c_item")
    hits = sized.where(F.col("n_shared") * 100 >= F.col("n_item") * percent).join(
        named, F.col("id").eqNullSafe(F.col("c_id")) & F.col("own").eqNullSafe(F.col("c_item")), "left_semi")
    return hits.select(F.col("id").alias(id_col), F.col("own").alias(item_col), "n_shared", "n_item")


def without_contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    hit = find_contained(docs, items, id_col, **options).select(F.col(id_col).alias("hit")).distinct()
    packed = docs.select(F.struct(*docs.columns).alias("doc"), docs[id_col].alias("id"))
    return packed.join(hit, F.col("id").eqNullSafe(F.col("hit")), "left_anti").select("doc.*")
