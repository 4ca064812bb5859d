"""Importance resampling towards a target's distribution of hashed n-grams.

Each n-gram falls into a bucket (unsigned crc32 of its bytes modulo
``buckets``); a bucket's gain is 1000 times the log ratio of its smoothed
frequencies in the target and in the corpus. A document's weight is the mean
gain of its n-grams, its score the weight plus Gumbel noise drawn from its id,
and the highest scores are drawn without replacement.

Python tasks intern the n-grams of about a megabyte of text at a time in an
open-addressed numpy table: keys are xxhash64 values, each claim is verified on
the bytes, a slot stores the bucket and the count, and the slot of every
occurrence gathers the gains. The corpus is read twice (counts, weights); what
the driver sees are ``buckets`` counts of each side.

Edge cases: null or empty text has no n-gram, weight 0 and is never drawn with
``min_words`` of 1 or more; a null id draws the noise of the empty id and comes
last among ties; rows that repeat an id are documents of their own, equal ones
take neighbouring ranks; an empty target or corpus counts nothing in all
buckets; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroll.llm.common import identified, materialize, text_chunks
from pressroll.operators.sequence import global_rank

BUCKETS = 10_000
#: Bytes of text interned in one table (at least one whole text).
BATCH_BYTES = 1 << 20
#: Longer n-grams are hashed and compared by the library, one by one.
LONG_GRAM = 1024

U64 = np.uint64
#: The primes of XXH64 (fixed values).
P1, P2, P3, P4, P5 = (U64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words after lower-casing: digits, a-z and all of characters beyond ASCII.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _left(x: np.ndarray, k: int) -> np.ndarray:
    return (x << U64(k)) | (x >> U64(64 - k))


def _lane(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _left(acc + lane * P2, 31) * P1


class Strings:
    """Byte strings ``data[start : start + length]`` as one numpy batch."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.data, self.start, self.length = padded, start, length
        #: The eight bytes from each position on, as little-endian integers.
        self.eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        self.four = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))

    def bytes_at(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.length[i]].tobytes()

    def xxhash64(self) -> np.ndarray:
        """XXH64 with seed 0 of every string."""
        start, length = self.start, self.length
        h = np.full(len(start), P5)
        stripes = length // 32
        striped = np.flatnonzero((stripes > 0) & (length <= LONG_GRAM))
        if len(striped):
            acc = [np.zeros(len(striped), U64) + x for x in (P2, P2, U64(0))] + [np.zeros(len(striped), U64) - P1]
            acc[0] += P1
            for i in range(int(stripes[striped].max())):
                live = np.flatnonzero(stripes[striped] > i)
                at = start[striped[live]] + 32 * i
                for k in range(4):
                    acc[k][live] = _lane(acc[k][live], self.eight[at + 8 * k])
            whole = _left(acc[0], 1) + _left(acc[1], 7) + _left(acc[2], 12) + _left(acc[3], 18)
            for k in range(4):
                whole = (whole ^ _lane(np.zeros_like(whole), acc[k])) * P1 + P4
            h[striped] = whole
        h += length.astype(U64)
        at, rest = start + stripes * 32, length % 32
        for i in range(3):
            live = np.flatnonzero(rest >= 8 * (i + 1))
            h[live] = _left(h[live] ^ _lane(np.zeros(len(live), U64), self.eight[at[live] + 8 * i]), 27) * P1 + P4
        at, rest = at + rest // 8 * 8, rest % 8
        live = np.flatnonzero(rest >= 4)
        h[live] = _left(h[live] ^ (self.four[at[live]].astype(U64) * P1), 23) * P2 + P3
        at, rest = at + rest // 4 * 4, rest % 4
        for i in range(3):
            live = np.flatnonzero(rest > i)
            h[live] = _left(h[live] ^ (self.data[at[live] + i].astype(U64) * P5), 11) * P1
        h ^= h >> U64(33)
        h *= P2
        h ^= h >> U64(29)
        h *= P3
        h ^= h >> U64(32)
        for i in np.flatnonzero(length > LONG_GRAM):
            h[i] = xxhash.xxh64_intdigest(self.bytes_at(i))
        return h

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the strings numbered ``a`` and ``b`` agree byte for byte."""
        equal = self.length[a] == self.length[b]
        open_ = np.flatnonzero(equal & (a != b))
        long = open_[self.length[a[open_]] > LONG_GRAM]
        for i in long:
            equal[i] = self.bytes_at(a[i]) == self.bytes_at(b[i])
        open_ = open_[self.length[a[open_]] <= LONG_GRAM]
        at = 0
        while len(open_):
            left = self.length[a[open_]] - at
            differ = self.eight[self.start[a[open_]] + at] ^ self.eight[self.start[b[open_]] + at]
            differ <<= (8 * np.maximum(8 - left, 0)).astype(U64)
            equal[open_[differ != 0]] = False
            at += 8
            open_ = open_[(differ == 0) & (left > 8)]
        return equal


class GramTable:
    """Open-addressed table of the distinct strings of a batch: ``slots`` has
    the slot of every occurrence, ``bucket`` and ``count`` what a slot stores."""

    def __init__(self, grams: Strings, buckets: int) -> None:
        n = len(grams.start)
        keys = grams.xxhash64()
        mask = (1 << max(4, (2 * n).bit_length())) - 1
        owner = np.full(mask + 1, -1, np.int64)
        self.slots = np.zeros(n, np.int64)
        slot = (keys & U64(mask)).astype(np.int64)
        waiting = np.arange(n)
        while len(waiting):
            at = slot[waiting]
            free = owner[at] < 0
            owner[at[free]] = waiting[free]
            holder = owner[at]
            found = keys[holder] == keys[waiting]
            match = np.flatnonzero(found)
            found[match] = grams.same(holder[match], waiting[match])
            self.slots[waiting[found]] = at[found]
            waiting = waiting[~found]
            slot[waiting] = (slot[waiting] + 1) & mask
        self.count = np.bincount(self.slots, minlength=mask + 1)
        self.bucket = np.zeros(mask + 1, np.int64)
        used = np.flatnonzero(owner >= 0)
        data, first, last = grams.data.tobytes(), grams.start[owner[used]], (grams.start + grams.length)[owner[used]]
        self.bucket[used] = [zlib.crc32(data[a:b]) % buckets for a, b in zip(first.tolist(), last.tolist())]
        self.used = used


def _grams(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, int]) -> tuple[Strings, np.ndarray, np.ndarray]:
    """The n-grams of a run of texts, the text of each, and the words of each text."""
    data = _LOWER[data]
    inside = _IN_WORD[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    start = np.flatnonzero(begins)
    length = np.flatnonzero(ends) + 1 - start
    first = np.searchsorted(start, offsets)
    words = np.diff(first)
    text = np.repeat(np.arange(len(words)), words)
    if sizes == (1, 1):
        return Strings(data, start, length), text, words
    # Words joined by one space each, so that an n-gram is a slice.
    place = np.cumsum(length + 1) - length - 1
    source = np.arange(int((length + 1).sum())) - np.repeat(place - start, length + 1)
    joined = np.append(data, np.uint8(32))[np.minimum(source, len(data))]
    joined[place + length] = 32
    starts, lengths, texts = [], [], []
    for n in range(sizes[0], sizes[1] + 1):
        at = np.arange(max(0, len(start) - n + 1))
        at = at[text[at] == text[at + n - 1]] if len(at) else at
        starts.append(place[at])
        lengths.append(place[at + n - 1] + length[at + n - 1] - place[at])
        texts.append(text[at])
    order = np.argsort(np.concatenate(texts), kind="stable")
    return Strings(joined, np.concatenate(starts)[order], np.concatenate(lengths)[order]), np.concatenate(texts)[order], words


def _count_task(sizes: tuple[int, int], buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0), BATCH_BYTES):
                table = GramTable(_grams(data, offsets, sizes)[0], buckets)
                np.add.at(total, table.bucket[table.used], table.count[table.used])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, text_col: str, sizes: tuple[int, int], buckets: int) -> np.ndarray:
    """Occurrences of each bucket in all texts (``buckets`` numbers)."""
    partial = identified(texts, text_col).mapInArrow(_count_task(sizes, buckets), "bucket long, n long")
    summed = partial.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the ratio of smoothed frequencies) of each bucket."""
    k, total_s, total_t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (total_s + k) / ((s + 1) * (total_t + k))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _weight_task(sizes: tuple[int, int], gain):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = gain.value
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column("text"), BATCH_BYTES):
                grams, text, words = _grams(data, offsets, sizes)
                table = GramTable(grams, len(of))
                n = np.bincount(text, minlength=hi - lo)
                sums = np.zeros(len(text) + 1, np.int64)
                np.cumsum(of[table.bucket[table.slots]], out=sums[1:])
                last = np.cumsum(n)
                weight = (sums[last] - sums[last - n]) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight)],
                    ["id", "n_words", "n_features", "weight"])

    return weigh


def gumbel_noise(id_col: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) drawn from the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             sizes: tuple[int, int] = (1, 1), buckets: int = BUCKETS, percent: int = 10, min_words: int = 20,
             seed: int = 2024) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_features``, ``weight``,
    ``score`` and ``rank`` (from 1 on; null where it isn't drawn). Drawn are
    ``percent`` % of the documents with ``min_words`` words or more."""
    gain = gains(bucket_counts(docs, text_col, sizes, buckets), bucket_counts(target, target_col, sizes, buckets))
    rows = identified(docs, id_col, text_col).toDF("id", "text")
    shipped = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket, whatever the input
    weighed = rows.mapInArrow(_weight_task(sizes, shipped),
                              f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")
    scored = materialize(weighed.withColumn("score", F.col("weight") + gumbel_noise(F.col("id"), seed)), "resample-scores")
    n_drawn = scored.where(F.col("n_words") >= min_words).count() * percent // 100
    ordered = scored.select("*", (F.col("n_words") < min_words).alias("_short"), (-F.col("score")).alias("_down"),
                            F.col("id").isNull().alias("_no_id"))
    ranked = global_rank(ordered, ["_short", "_down", "_no_id", "id", "weight", "n_features"], "_place")
    return ranked.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score",
                         F.when(F.col("_place") < n_drawn, F.col("_place") + 1).alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents drawn, with all their columns (rows that repeat an id stay
    or go together)."""
    chosen = resample(docs, target, id_col, text_col, **options).where("rank IS NOT NULL").select(F.col(id_col).alias("_drawn")).distinct()
    return docs.join(chosen, docs[id_col].eqNullSafe(chosen["_drawn"]), "left_semi")
