"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents share one expected number of copies, target / size of the
source. Its whole part is given to each; the fractions are rounded so that the
words taken of a source stay at its target: two fractions are paired, words
move from one to the other at random (in expectation each keeps its fraction)
until one becomes 0 or 1, and the other is paired on. This runs in groups of
about ``GROUP`` documents; what each group leaves over, at most one fraction,
meets others in the next level of the tree, up to one per source, which goes to
the nearer side. A source's taken words therefore miss its target by at most
half a document; long documents come first in a group, so the last is short.

DataFrame expressions only. Draws are hashes of ids, so reruns agree. Equal rows
(source, id, size) are one unit with a count, so repeats cannot fill a group.

Edge cases: null or empty text has size 0, is never rounded and takes 0 words; a
null source is the last source; null and repeated ids are documents like others;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pressroll.llm.common import WORD, identified, materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
GROUP = 64
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / F.lit(float(1 << 40))


def source_targets(units: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """``(source, source_size, target)``: one row per source. A source is full
    at ``most`` times its size; in the order in which sources fill up, each
    row's level is what the rest would get per unit of weight, and the highest
    of these is the level at which no target is above its limit."""
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1))
    filling = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    limit = F.col("source_size") * most
    before = F.sum(limit).over(filling.rowsBetween(W.unboundedPreceding, -1))
    rest = F.sum("weight").over(filling.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    level = (total * share - F.coalesce(before, F.lit(0))) / rest
    levels = numbered.withColumn("level", level)
    top = F.max("level").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return levels.select("source", "source_size", F.least(limit.cast("double"), top * F.col("weight")).alias("target"))


def _pair(level: int) -> Callable[[Column, Column], Column]:
    """Step of the fold over a group: ``acc`` holds a fraction (or none) and the
    units already rounded; ``x`` is the next unit."""

    def unit(x: Column, p: Column) -> Column:
        return F.struct(x["id"].alias("id"), x["size"].alias("size"), x["n"].alias("n"), p.alias("p"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["held"]
        ratio = x["size"] / a["size"]
        room = F.struct(F.least(1 - a["p"], x["p"] * ratio).alias("up"), F.least(a["p"], (1 - x["p"]) * ratio).alias("down"),
                        _uniform(a["id"], x["id"], a["size"], x["size"], F.lit(SEED + level)).alias("draw"))

        def move(t: Column) -> Column:
            up = t["draw"] * (t["up"] + t["down"]) < t["down"]
            pa = F.when(up, F.when(t["up"] >= 1 - a["p"], 1.0).otherwise(a["p"] + t["up"])).otherwise(
                F.when(t["down"] >= a["p"], 0.0).otherwise(a["p"] - t["down"]))
            px = F.when(up, F.when(t["up"] >= x["p"] * ratio, 0.0).otherwise(x["p"] - t["up"] / ratio)).otherwise(
                F.when(t["down"] >= (1 - x["p"]) * ratio, 1.0).otherwise(x["p"] + t["down"] / ratio))
            return F.array(unit(a, pa), unit(x, px))

        open_ = lambda u: (u["p"] > 1e-12) & (u["p"] < 1 - 1e-12)
        moved = _let(_let(room, move), lambda two: F.struct(
            F.get(F.filter(two, open_), F.lit(0)).alias("held"),
            F.concat(acc["done"], F.filter(two, lambda u: ~open_(u))).alias("done")))
        return F.when(a.isNull(), F.struct(x.alias("held"), acc["done"].alias("done"))).otherwise(moved)

    return step


def _round(fractions: DataFrame, level: int, groups: DataFrame, kind: str) -> DataFrame:
    """One level of the tree: per group the held unit and the rounded ones."""
    joined = fractions.join(groups, fractions["source"].eqNullSafe(groups["of"]))
    grouped = joined.withColumn("group", F.pmod(F.xxhash64("id", "size", F.lit(SEED * 100 + level)), F.col("groups")))
    units = F.sort_array(F.collect_list(F.struct(
        (-F.col("size")).alias("order"), F.xxhash64("id", F.lit(SEED)).alias("tie"), "id", "size", "n", "p")))
    unit = f"struct<id:{kind},size:bigint,n:bigint,p:double>"
    listed = grouped.groupBy("source", "group").agg(units.alias("units")).withColumn(
        "units", F.transform("units", lambda u: F.struct(u["id"].alias("id"), u["size"].alias("size"), u["n"].alias("n"), u["p"].alias("p"))))
    start = F.struct(F.lit(None).cast(unit).alias("held"), F.array().cast(f"array<{unit}>").alias("done"))
    return listed.select("source", F.aggregate("units", start, _pair(level)).alias("r")).select("source", "r.held", "r.done")


def copies(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
           weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """One row per unit of equal documents: ``source, id, size, n, source_size,
    target, total`` (copies that its n documents take together)."""
    sizes = identified(docs, id_col, source_col, text_col).toDF("id", "source", "text").select(
        "id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    kind = sizes.schema["id"].dataType.simpleString()
    units = materialize(sizes.groupBy("source", "id", "size").agg(F.count("*").alias("n")), "sizes")
    targets = materialize(source_targets(units, weights, share, most), "targets")
    t = targets.withColumnRenamed("source", "of")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.join(t, units["source"].eqNullSafe(t["of"])).drop("of").withColumn("exact", F.col("n") * each)
    units = units.withColumn("whole", F.floor(F.col("exact") + 1e-9)).withColumn("p", F.greatest(F.col("exact") - F.col("whole"), F.lit(0.0)))
    rounded = (F.col("size") > 0) & (F.col("p") > 1e-9)
    left = units.where(rounded).select("source", "id", "size", "n", "p")
    done, level = [], 0
    while True:
        counts = left.groupBy("source").agg(F.count("*").alias("count"))
        groups = counts.select(F.col("source").alias("of"), F.ceil(F.col("count") / GROUP).alias("groups"))
        table = materialize(_round(left, level, groups, kind), "rounding")
        done.append(table.select("source", F.explode("done").alias("u")).select("source", "u.*"))
        left = table.where(F.col("held").isNotNull()).select("source", "held.*")
        level += 1
        if (left.groupBy("source").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0) <= 1:
            break
    last = left.withColumn("p", (F.col("p") >= 0.5).cast("double"))
    extra = last
    for part in done:
        extra = extra.union(part)
    extra = extra.select(F.col("source").alias("s"), F.col("id").alias("i"), F.col("size").alias("z"), (F.col("p") > 0.5).cast("long").alias("extra"))
    same = F.col("source").eqNullSafe(F.col("s")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("size") == F.col("z"))
    return units.join(extra, same, "left").select("source", "id", "size", "n", "source_size", "target",
                                                  (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("total"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target`` (of its
    source), ``copies`` and ``taken`` (words, repeats counted)."""
    units = copies(docs, id_col, **options)
    each = units.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    number = F.floor(F.col("total") / F.col("n")) + (F.col("k") <= F.col("total") % F.col("n")).cast("long")
    return each.select(F.col("id").alias(id_col), "size", "source_size", "target", number.alias("copies")).withColumn(
        "taken", F.col("copies") * F.col("size"))


def repeated(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The documents, each as often as the mix takes it, with all their columns."""
    units = copies(docs, id_col, source_col, text_col, **options).select(
        F.col("source").alias("s"), F.col("id").alias("i"), F.col("size").alias("z"), "n", "total")
    packed = docs.select(F.struct(*docs.columns).alias("doc"), docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"),
                         word_count(docs[text_col]).alias("size"))
    joined = packed.join(units, F.col("source").eqNullSafe(F.col("s")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("size") == F.col("z")))
    # Rows with the same source, id and size share the unit's copies.
    single = joined.where("n = 1").withColumn("k", F.lit(1))
    shared = joined.where("n > 1").withColumn("k", F.row_number().over(W.partitionBy("s", "i", "z").orderBy(f"doc.{text_col}")))
    number = F.floor(F.col("total") / F.col("n")) + (F.col("k") <= F.col("total") % F.col("n")).cast("long")
    return single.unionByName(shared).withColumn("copies", number).where("copies > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")
