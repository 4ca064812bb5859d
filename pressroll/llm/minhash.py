"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian
pruning of signature batches, exact verification, connected components.

* A document's set holds its distinct shingles of five words (A-Z lower-cased;
  with fewer words the whole sequence; without words it is empty).
* Documents with the same set are one class from the start (their similarity
  is 1), so copies cost one row each and no pairs.
* Classes are hashed into bands. In each bucket the classes are compared with
  the smallest of the bucket; what this links is merged; buckets that still
  hold several components are then compared in full, so no candidate is lost.
* A candidate's signatures are compared batch by batch. With m of n equal
  values the similarity has the posterior Beta(m + 1, n - m + 1); the pair is
  dropped as soon as P(similarity >= threshold) falls below ``miss``.
* Survivors are confirmed on the full sets.

Edge cases: null or empty text has an empty set and links with nothing; a null
id gets no component and is kept; rows that repeat an id are one node and all
are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pressroll.llm.common import identified, materialize, mix, shingle_hashes, text_chunks, words_of
from pressroll.llm.components import connected_components
from pressroll.session import bound_batches

SHINGLE_WORDS = 5
PERCENT = 75
BANDS, ROWS = 48, 6
BATCH = 48
#: Documents of a bucket that are compared with one another at a time.
BLOCK = 768
#: Chance at which the posterior lets a pair of the threshold's similarity go.
MISS = 1e-5

_A = (mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(7001, 7001 + BANDS * ROWS, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def _signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values of the non-empty runs of ``hashes`` that begin at
    ``first``: 16 bits of each minimum, mixed, as the upper bits of a small
    minimum (of a long text) say nothing."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first), len(_A)), np.uint16)
    for k in range(len(_A)):
        v = short * _A[k]
        v ^= v >> np.uint32(15)
        v += _B[k]
        least = np.minimum.reduceat(v * np.uint32(0x2C1B3C6D), first)
        least ^= least >> np.uint32(15)
        out[:, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, and where each text's begin."""
    hashes, docs = shingle_hashes(words_of(data, offsets, lower=True), SHINGLE_WORDS)
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    hashes, docs = hashes[new], docs[new]
    return hashes, np.searchsorted(docs, np.arange(len(offsets)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, data, offsets in text_chunks(batch.column(1)):
            hashes, first = _sets(data, offsets)
            n = np.diff(first)
            full = np.flatnonzero(n)
            low, high = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
            signature = np.empty(hi - lo, object)
            if len(full):
                low[full] = np.add.reduceat(mix(hashes), first[full])
                high[full] = np.bitwise_xor.reduceat(mix(hashes + np.uint64(77)), first[full])
                for i, row in zip(full, _signatures(hashes, first[full]), strict=True):
                    signature[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(low.view(np.int64)),
                 pa.array(high.view(np.int64)), pa.array(signature, pa.binary())],
                ["id", "n", "low", "high", "signature"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factor = mix(np.arange(501, 501 + ROWS, dtype=np.uint64)) | np.uint64(1)
    for batch in batches:
        if not batch.num_rows:
            continue
        values = _matrix(batch.column("signature")).astype(np.uint64).reshape(-1, BANDS, ROWS)
        keys = mix((values * factor).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.reshape(-1).view(np.int64)), batch.column("id").take(pa.array(np.repeat(np.arange(len(keys)), BANDS))),
             batch.column("n").take(pa.array(np.repeat(np.arange(len(keys)), BANDS)))], ["bucket", "id", "n"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BANDS * ROWS)


def least_matches(n: int, percent: int, miss: float) -> int:
    """The fewest equal values of n at which P(similarity >= percent/100) is
    still ``miss`` or more. P(Beta(m+1, n-m+1) > t) = P(Binomial(n+1, t) <= m)."""
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def _steps(percent: int, miss: float) -> list[tuple[int, int]]:
    """After so many compared values a candidate needs so many equal ones."""
    return [(n, least_matches(n, percent, miss)) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]


def _prune(percent: int, miss: float):
    steps = _steps(percent, miss)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = _matrix(batch.column("sa")), _matrix(batch.column("sb"))
            alive, equal = np.arange(len(left)), np.zeros(len(left), np.int64)
            for n, least in steps:
                part = slice(n - BATCH, n)
                equal[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
                alive = alive[equal[alive] >= least]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return prune


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(_set_list(batch.column("ta")), _set_list(batch.column("tb")), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([_similar(x, y, percent) for x, y in pairs], pa.bool_()))

    return confirm


def _across(percent: int, miss: float):
    """Links between components in a pair of blocks of a bucket (a block with
    itself where i = j); pairs that found links have joined are passed over."""
    steps = _steps(percent, miss)

    def across(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids = group["id"].to_pylist()
        sets = _set_list(group["text"])
        names = {c: c for c in group["component"].to_pylist()}

        def root(c):
            while names[c] != c:
                names[c] = c = names[names[c]]
            return c

        signatures = _matrix(group["signature"].combine_chunks())
        component = group["component"].to_pylist()
        size = np.array([len(x) for x in sets])
        block = group["own"].to_numpy()
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        left = np.flatnonzero(block == i)
        found = []
        for x in left:
            y = np.flatnonzero(block == j)
            if i == j:
                y = y[y > x]
            y = y[np.minimum(size[y], size[x]) * 100 >= np.maximum(size[y], size[x]) * percent]
            equal = np.zeros(len(y), np.int64)
            for n, least in steps:
                part = slice(n - BATCH, n)
                equal += (signatures[y, part] == signatures[x, part]).sum(axis=1)
                y, equal = y[equal >= least], equal[equal >= least]
            for k in y:
                if root(component[x]) != root(component[k]) and _similar(sets[x], sets[k], percent):
                    names[root(component[x])] = root(component[k])
                    found.append((max(ids[x], ids[k]), min(ids[x], ids[k])))
        kind = group.schema.field("id").type
        return pa.table({"a": pa.array([a for a, _ in found], kind), "b": pa.array([b for _, b in found], kind)})

    return across


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def _set_list(column: pa.Array) -> list[np.ndarray]:
    out = []
    for _, _, data, offsets in text_chunks(column):
        hashes, first = _sets(data, offsets)
        out += [hashes[first[i] : first[i + 1]] for i in range(len(offsets) - 1)]
    return out


def _links(pairs: DataFrame, signatures: DataFrame, texts: DataFrame, percent: int, miss: float) -> DataFrame:
    """Of candidate pairs ``(a, b)`` those whose sets are similar enough."""
    kind = pairs.select("a", "b").schema
    side = lambda df, name, value: df.select(F.col("id").alias(name), F.col(value).alias(f"{value[0]}{name}"))
    both = pairs.join(side(signatures, "a", "signature"), "a").join(side(signatures, "b", "signature"), "b")
    alive = materialize(both.select("a", "b", "sa", "sb").mapInArrow(_prune(percent, miss), kind), "survivors")
    both = alive.join(side(texts, "a", "text"), "a").join(side(texts, "b", "text"), "b")
    return materialize(both.select("a", "b", "ta", "tb").mapInArrow(_confirm(percent), kind).distinct(), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (smallest id
    reachable over links of ``percent`` similarity or more), ``kept``."""
    bound_batches(docs.sparkSession)
    texts = identified(docs, id_col, text_col).toDF("id", "text")
    id_type = texts.schema["id"].dataType.simpleString()
    features = materialize(
        texts.mapInArrow(_features, f"id {id_type}, n long, low long, high long, signature binary"), "features")
    linked = features.where("n > 0 and id is not null")
    classes = materialize(linked.groupBy("low", "high", "n").agg(F.min("id").alias("id")), "classes")
    member = linked.select("id", "low", "high", "n").distinct().join(
        classes.withColumnRenamed("id", "class"), ["low", "high", "n"]).select("id", "class")
    first = linked.join(classes, ["low", "high", "n", "id"], "left_semi").dropDuplicates(["id", "low", "high"])
    first = materialize(first.select("id", "n", "signature"), "signatures")
    # The texts of classes alone take part in verification.
    own = texts.join(first.select("id"), "id", "left_semi")

    bands = first.mapInArrow(_bands, f"bucket long, id {id_type}, n long")
    # The smallest id of a bucket with its set's size, or the least and the largest where rows repeat the id.
    shared = bands.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("low"), F.min(F.struct("id", (-F.col("n")).alias("n"))).alias("high"),
                                         F.count("*").alias("size")).where("size > 1")
    shared = shared.select("bucket", F.col("low.id").alias("centre"), F.col("low.n").alias("nb"), (F.col("low.n") == -F.col("high.n")).alias("sure"), "size")
    rows = materialize(bands.join(shared, "bucket"), "buckets")
    near = (F.least("n", "nb") * 100 >= F.greatest("n", "nb") * percent) | ~F.col("sure")
    stars = rows.where("id > centre").where(near).select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()
    links = _links(stars, first, own, percent, miss)

    # Buckets that still hold several components: all of it in blocks.
    part = connected_components(links)
    placed = rows.select("bucket", "id").distinct().join(part, "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"),
                                         F.count("*").alias("size")).where("x < y and size > 2")
    blocks = open_.select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("id", "bucket"), F.col("blocks")).cast("int")
    pairs = (placed.join(blocks, "bucket").withColumn("own", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("bucket", "id", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    full = pairs.join(first.select("id", "signature"), "id").join(own, "id")
    kind = f"a {id_type}, b {id_type}"
    more = materialize(full.select("bucket", "i", "j", "id", "component", "own", "signature", "text").groupBy("bucket", "i", "j")
                       .applyInArrow(_across(percent, miss), kind).distinct(), "links")

    copies = member.where("id <> class").select(F.col("id").alias("a"), F.col("class").alias("b"))
    part = connected_components(links.union(more).union(copies))
    out = features.select("id", "n").join(part, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents of which one stays per group, with all their columns: the
    smallest id of a component, and of rows that repeat it the first by text."""
    kept = near_duplicates(docs, id_col, text_col, **options).where("kept").select(F.col(id_col).alias("id")).distinct()
    packed = docs.select(F.struct(*docs.columns).alias("doc"), docs[id_col].alias("id"))
    first = F.row_number().over(W.partitionBy("id").orderBy(f"doc.{text_col}"))
    one = packed.where("id is not null").join(kept, "id", "left_semi").withColumn("row", first).where("row = 1")
    return one.select("doc.*").unionByName(docs.where(docs[id_col].isNull()))
